"""String distances that Spark has no built-in for."""

from __future__ import annotations


def damerau_levenshtein(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, with edits between swapped letters allowed."""
    width = len(b) + 2
    far = len(a) + len(b)
    table = [[far] * width, [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, match = [far, i] + [0] * len(b), 0
        above = table[i]
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1))
        table.append(row)
        seen[x] = i
    return table[-1][-1]


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for y, t in zip(b, taken, strict=True) if t]
    m = len(first)
    half = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base = jaro(a, b)
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return base + 0.1 * prefix * (1 - base) if base > 0.7 else base
