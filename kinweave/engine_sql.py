"""SQL for the heart of the engine over the contact view: name relations, scored pairs, greedy groups, golden records.

Each piece is a list of common table expressions that stands on those before it.
"""

from __future__ import annotations

from .functions.constants import NAME_WEIGHTS


def typo(x: str, y: str) -> str:
    short, more = f"least(length({x}), length({y}))", f"abs(length({x}) - length({y}))"
    return f"""({x} <> {y} AND {short} >= 4 AND left({x}, 1) = left({y}, 1) AND {more} <= 2
      AND NOT ({more} = 1 AND left({x}, {short}) = left({y}, {short})) AND NOT ({more} = 0 AND left({x}, {short} - 1) = left({y}, {short} - 1))
      AND NOT CASE WHEN {more} = 0 AND {short} < 5 THEN hamming({x}, {y}) = 1 ELSE FALSE END
      AND (damerau_levenshtein({x}, {y}) = 1 OR (damerau_levenshtein({x}, {y}) = 2 AND {short} >= 8)))"""


_ANY_TYPO = " OR ".join(f"coalesce({typo(f'a.ws[{i}]', f'b.ws[{j}]')}, FALSE)" for i in (1, 2) for j in (1, 2))

#: wrel: how two words relate as given names and as family names; words are the view's given and family names.
WORDS = f"""
wd AS (SELECT DISTINCT g AS w, gs AS ws FROM x UNION SELECT DISTINCT f, [f] FROM x),
wrel AS (SELECT a.w AS w1, b.w AS w2,
  CASE WHEN a.w = '' OR b.w = '' THEN 'no' WHEN a.w = b.w THEN 'equal' WHEN list_has_any(a.ws, b.ws) THEN 'nick'
    WHEN (length(a.w) = 1 AND len(list_filter(b.ws, lambda y: starts_with(y, a.w))) > 0) OR (length(b.w) = 1 AND len(list_filter(a.ws, lambda y: starts_with(y,
        b.w))) > 0) THEN 'initial'
    WHEN {_ANY_TYPO} THEN 'typo' ELSE 'no' END AS giv,
  CASE WHEN a.w = b.w THEN 'equal' WHEN {typo("a.w", "b.w")} THEN 'typo' ELSE 'no' END AS fam
  FROM wd a CROSS JOIN wd b)"""


def compared(pairs: str) -> str:
    """a, b and names (how they relate) of a table of pairs."""
    return f"""SELECT p.a, p.b, CASE
    WHEN ff.fam = 'equal' THEN CASE gg.giv WHEN 'equal' THEN 'exact' WHEN 'nick' THEN 'nickname' WHEN 'no' THEN 'different' ELSE gg.giv END
    WHEN ff.fam = 'typo' THEN CASE gg.giv WHEN 'no' THEN 'different' WHEN 'initial' THEN 'initial' ELSE 'typo' END
    WHEN (gf.fam <> 'no' AND fg.giv <> 'no') OR (hf.fam <> 'no' AND fh.giv <> 'no') THEN 'swapped'
    WHEN gg.giv <> 'no' AND jaro_winkler_similarity(m.f, n.f) >= 0.85 THEN 'similar'
    WHEN gg.giv IN ('equal', 'nick') THEN 'family_differs' ELSE 'different' END AS names
  FROM {pairs} p JOIN x m ON m.id = p.a JOIN x n ON n.id = p.b
  JOIN wrel gg ON gg.w1 = m.g AND gg.w2 = n.g JOIN wrel ff ON ff.w1 = m.f AND ff.w2 = n.f
  JOIN wrel gf ON gf.w1 = m.g AND gf.w2 = n.f JOIN wrel fg ON fg.w1 = m.f AND fg.w2 = n.g
  JOIN wrel hf ON hf.w1 = n.g AND hf.w2 = m.f JOIN wrel fh ON fh.w1 = n.f AND fh.w2 = m.g"""


_NAMES = {
    "nickname": "'names ' || dd || ' via nickname'", "swapped": "'names ' || dd || ' with first and last swapped'", "typo": "'names ' || dd || ' differ by a letter or two'",
    "initial": "'names ' || dd || ': an initial that fits'", "similar": "'names ' || dd || ': same first name, close last names'",
    "family_differs": "'same first name but different last names: ' || dd", "different": "'different names: ' || dd",
}

#: sh, she: numbers and emails that several people hold. In the view these are landlines, where short forms and slips of a
#: given name are one person's, and what two copies of one person share if their names don't fit.
SHARED = f"""
two AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.pid = b.pid AND a.copy = 0 AND b.copy = 1),
tcmp AS ({compared("two")}),
sh AS (SELECT phone_key FROM (SELECT phone_key, f || '|' || CASE g WHEN 'bob' THEN 'robert' WHEN 'liz' THEN 'elizabeth' WHEN 'mike' THEN 'michael'
    WHEN 'jonathon' THEN 'jonathan' ELSE g END AS person
  FROM x WHERE copy = 2) GROUP BY phone_key HAVING count(DISTINCT person) > 1 UNION ALL SELECT phone_key FROM tcmp JOIN x ON id = a WHERE names = 'different'),
she AS (SELECT email_key FROM tcmp JOIN x ON id = a WHERE names = 'different')"""

#: scored: pairs that reach a tier, with their evidence.
SCORED = f"""{WORDS},{SHARED},
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM capped a JOIN capped b USING (key) WHERE a.id < b.id),
cmp AS ({compared("cand")}),
pair AS (SELECT c.a, c.b, c.names, m.formatted_name AS d1, n.formatted_name AS d2, CASE WHEN m.formatted_name = n.formatted_name THEN m.formatted_name
    ELSE m.formatted_name || ' / ' || n.formatted_name END AS dd,
  m.phone_key = n.phone_key AS phone, m.phone_key IN (SELECT phone_key FROM sh) AS many, '+91 ' || substr(m.phone_key, 4, 5) || ' ' || substr(m.phone_key, 9) AS shown,
  ['mobile', 'work number', 'home number'][m.copy + 1] AS kind, m.email_key AS e1, n.email_key AS e2,
  m.pid % 12 = n.pid % 12 AND m.pid % 28 = n.pid % 28 AS day, m.copy <> 1 AND n.copy <> 1 AND m.pid % 60 = n.pid % 60 AS year, m.o <> '' AND m.o = n.o AS org
  FROM cmp c JOIN x m ON m.id = c.a JOIN x n ON n.id = c.b),
said AS (SELECT a, b, names, [
    CASE WHEN names = 'exact' AND d1 = d2 THEN 'same name, ' || d1
        WHEN names = 'exact' THEN 'same name written differently: ' || dd {" ".join(f"WHEN names = '{k}' THEN {t}" for k, t in _NAMES.items())} END,
    CASE WHEN phone AND many THEN 'both have ' || shown || ', but so do contacts with other names, so it counts for little'
        WHEN phone THEN 'same ' || kind || ' ' || shown ELSE 'no number in common' END,
    CASE WHEN e1 = e2 THEN 'same email ' || e1 WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN 'no email in common' END,
    CASE WHEN NOT day THEN 'different birthdays' WHEN year THEN 'same birthday' ELSE 'same birthday (day and month)' END,
    CASE WHEN org THEN 'same company' END] AS texts,
  CASE names {" ".join(f"WHEN '{k}' THEN {w}" for k, w in NAME_WEIGHTS.items())} END::FLOAT AS w1, CASE WHEN phone AND many THEN 0.1 WHEN phone THEN 0.6
      ELSE -0.15 END::FLOAT AS w2,
  CASE WHEN e1 = e2 THEN 0.5 WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN -0.15 ELSE 0 END::FLOAT AS w3, CASE WHEN NOT day THEN -1.0 WHEN year THEN 0.3
      ELSE 0.15 END::FLOAT AS w4,
  CASE WHEN org THEN 0.1 ELSE 0 END::FLOAT AS w5 FROM pair),
scored AS (SELECT a, b, names, array_to_string(list_filter(texts, lambda t: t IS NOT NULL), '; ') AS evidence, w1 + w2 + w3 + w4 + w5 AS score FROM said
    WHERE w1 + w2 + w3 + w4 + w5 >= 0.4::FLOAT)"""

def groups(apart: str = "FALSE") -> str:
    """grps: the groups that joining the pairs in order gives, component by component. grp and weak stand beside nodes.

    apart: which pairs of contacts m and n must not be joined, besides those that conflict.
    """
    return f"""{SCORED},
und AS (SELECT a, b FROM scored UNION ALL SELECT b, a FROM scored),
reach(p, q) AS (SELECT a, a FROM und UNION SELECT r.p, u.b FROM reach r JOIN und u ON r.q = u.a),
lab AS (SELECT p AS id, min(q) AS label FROM reach GROUP BY p),
comp AS (SELECT label, list(id ORDER BY id) AS nodes FROM lab GROUP BY label),
ed AS (SELECT label, list({{'a': a, 'b': b, 's': score}} ORDER BY score DESC, a, b) AS edges FROM scored JOIN lab ON lab.id = a GROUP BY label),
near AS (SELECT l.label, l.id AS a, m.id AS b FROM lab l JOIN lab m ON l.label = m.label AND l.id < m.id),
ncmp AS ({compared("near")}),
bad AS (SELECT label, list({{'a': near.a, 'b': near.b}}) AS apart FROM near JOIN ncmp USING (a, b) JOIN x m ON m.id = a JOIN x n ON n.id = b
  WHERE names = 'different' OR m.pid % 12 <> n.pid % 12 OR m.pid % 28 <> n.pid % 28 OR ({apart}) GROUP BY label),
walk(label, k, nodes, grp, weak) AS (
  SELECT label, 0, nodes, nodes, list_transform(nodes, lambda n: 'inf'::FLOAT) FROM comp
  UNION ALL
  SELECT label, k + 1, nodes, CASE WHEN joined THEN list_transform(grp, lambda q: CASE WHEN q = gb THEN ga ELSE q END) ELSE grp END,
    CASE WHEN joined THEN list_transform(weak, lambda w, i: CASE WHEN grp[i] = ga OR grp[i] = gb THEN least(wa, wb, s) ELSE w END) ELSE weak END
  FROM (SELECT *, ga <> gb AND len(list_filter(apart, lambda z: (grp[list_position(nodes, z.a)] = ga AND grp[list_position(nodes, z.b)] = gb)
      OR (grp[list_position(nodes, z.a)] = gb AND grp[list_position(nodes, z.b)] = ga))) = 0 AS joined
    FROM (SELECT w.*, edges[k + 1].s AS s, coalesce(apart, []) AS apart, grp[list_position(nodes, edges[k + 1].a)] AS ga, grp[list_position(nodes, edges[k + 1].b)] AS gb,
        weak[list_position(nodes, edges[k + 1].a)] AS wa, weak[list_position(nodes, edges[k + 1].b)] AS wb
      FROM walk w JOIN ed USING (label) LEFT JOIN bad USING (label) WHERE k < len(edges)))),
ended AS (SELECT walk.* FROM walk JOIN ed USING (label) WHERE k = len(edges)),
mem AS (SELECT label, unnest(nodes) AS id, unnest(grp) AS home, unnest(weak) AS weak FROM ended),
grps AS (SELECT min(id) AS grp, list(id ORDER BY id) AS members, min(weak) AS score FROM mem GROUP BY label, home HAVING count(*) > 1),
tiered AS (SELECT *, CASE WHEN score >= 1::FLOAT THEN 'sure' WHEN score >= 0.7::FLOAT THEN 'likely' WHEN score >= 0.4::FLOAT THEN 'check' END AS tier FROM grps)"""


GROUPS = groups()


def golden(merges: str) -> str:
    """gold: a merged contact for each row (merge, members) of a table. Places are those of the members in id order."""
    return f"""
of AS (SELECT merge, unnest(members) AS id FROM {merges}),
gm AS (SELECT of.merge, q.*, v.birthday AS saved, CASE q.copy WHEN 0 THEN v.birthday WHEN 1 THEN '--' || substr(v.birthday, 3, 2) || '-' || substr(v.birthday, 5, 2)
    ELSE split_part(v.birthday, '/', 3) || '-' || lpad(split_part(v.birthday, '/', 1), 2, '0') || '-' || lpad(split_part(v.birthday, '/', 2), 2, '0') END AS date FROM of
        JOIN q USING (id) JOIN v USING (id)),
pts AS (SELECT m.merge, m.id, m.formatted_name, m.quality + sum(CASE WHEN n.id <> m.id AND n.f = m.f AND m.f <> '' THEN 1 ELSE 0 END + CASE WHEN n.id <> m.id
    AND m.g <> '' AND list_contains(n.gs, m.g) THEN 1 ELSE 0 END) AS points
  FROM gm m JOIN gm n USING (merge) GROUP BY m.merge, m.id, m.formatted_name, m.quality),
gname AS (SELECT merge, id AS pick, formatted_name FROM (SELECT *, row_number() OVER (PARTITION BY merge ORDER BY points DESC, id) AS k FROM pts) WHERE k = 1),
gph AS (SELECT merge, list(value ORDER BY first) AS phones FROM (SELECT merge, phone_key, min(id) AS first,
    CASE WHEN arg_min(phone, id) LIKE '+%' THEN arg_min(phone, id) ELSE coalesce(arg_min(phone, id) FILTER (phone LIKE '+%'), arg_min(phone, id)) END AS value FROM gm
        GROUP BY merge, phone_key) GROUP BY merge),
gem AS (SELECT merge, list(value ORDER BY first) AS emails FROM (SELECT merge, email_key, min(id) AS first, arg_min(email, id) AS value FROM gm WHERE email <> ''
    GROUP BY merge, email_key) GROUP BY merge),
gbd AS (SELECT merge, date FROM (SELECT merge, date, row_number() OVER (PARTITION BY merge ORDER BY date LIKE '--%', count(*) DESC, min(id)) AS k FROM gm GROUP BY merge,
    date) WHERE k = 1),
gorg AS (SELECT merge, arg_min(org, id) AS org FROM (SELECT gm.merge, gm.id, gm.org FROM gm JOIN (SELECT merge, low FROM (SELECT merge, low,
    row_number() OVER (PARTITION BY merge ORDER BY count(*) DESC, min(id)) AS k
    FROM (SELECT merge, id, lower(org) AS low FROM gm WHERE org <> '') GROUP BY merge, low) WHERE k = 1) w ON w.merge = gm.merge AND w.low = lower(gm.org))
        GROUP BY merge),
gnt AS (SELECT merge, 'Note ' || pid AS note, min(id) AS first FROM gm GROUP BY merge, pid),
gnote AS (SELECT merge, string_agg(note, chr(10) || chr(10) ORDER BY first) AS note FROM gnt a WHERE NOT EXISTS (SELECT 1 FROM gnt b WHERE b.merge = a.merge
    AND b.note <> a.note AND contains(b.note, a.note)) GROUP BY merge),
gold AS (SELECT merge, pick, formatted_name, array_to_string(phones, ',') AS phones, coalesce(array_to_string(emails, ','), '') AS emails, date AS birthday,
    coalesce(org, '') AS org, note
  FROM gname JOIN gph USING (merge) LEFT JOIN gem USING (merge) JOIN gbd USING (merge) LEFT JOIN gorg USING (merge) JOIN gnote USING (merge))"""
