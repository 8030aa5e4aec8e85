"""Word lists, dictionaries and weights that decide results. Fixed values, in natural order."""

# Name titles, suffixes, notes that people add to names, relation words and company words.
HONORIFICS = frozenset("dame dr fr frau herr miss mlle mme mr mrs ms mx prof rev shri sir smt sr sra sri srta".split())
SUFFIXES = frozenset("cpa dds esq ii iii iv jr mba md phd sr".split())
ANNOTATIONS = frozenset("2 3 biz business cell copy family home house landline main mobile new office old other personal private residence work".split())
ROLES = frozenset("abba amma ammi appa auntie aunty bro dad dada daddy dadi father gran grandma grandpa granny hubby husband maa mama mom mommy mother mum mummy my nana nani nanu papa pappa sis uncle wife".split())
COMPANY_WORDS = frozenset("ag bv co company corp corporation gmbh inc limited llc llp ltd plc private pvt sa srl the".split())

# Full names and their short forms.
_SHORT_FORMS = """
abigail: abby
alexander: alex
alexandra: alex
andrew: andy drew
anthony: tony
benjamin: ben
catherine: kate katie kathy
christina: chris
christine: chris
christopher: chris
daniel: dan danny
david: dave
deborah: debbie
edward: ed eddie ted
elizabeth: beth betty liz lizzie
francisco: paco
gregory: greg
james: jim jimmy jamie
jennifer: jen jenny
john: jack johnny
jose: pepe
josef: sepp jupp
joseph: joe
katherine: kate katie kathy
kathryn: kate katie kathy
margaret: maggie meg peggy
matthew: matt
michael: mike mick
nicholas: nick
patricia: pat
patrick: pat
richard: rick rich dick
robert: bob bobby rob robbie
samantha: sam
samuel: sam
stephen: steve
steven: steve
susan: sue susie
theodore: ted
thomas: tom tommy
timothy: tim
victoria: vicky
william: bill billy will
"""


def _nicknames() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in _SHORT_FORMS.split("\n"):
        full, _, short = line.partition(":")
        for s in short.split():
            out.setdefault(s, []).append(full)
    return out


NICKNAMES = _nicknames()

# Letters that lose more than an accent when folded, and those that vanish.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "'": "", "’": "", "`": ""}

# Evidence weights of name relations (32-bit floats), tiers and the cap on name blocks.
NAME_WEIGHTS = {"exact": 0.5, "nickname": 0.4, "swapped": 0.4, "typo": 0.35, "initial": 0.3, "similar": 0.2, "partial": 0.15, "family_differs": -0.3, "different": -1.0}
# The texts of evidence. both: the two names, or the one that they share.
EVIDENCE = {
    "exact": "same name, {both}",
    "written": "same name written differently: {both}",
    "nickname": "names {both} via nickname",
    "swapped": "names {both} with first and last swapped",
    "typo": "names {both} differ by a letter or two",
    "initial": "names {both}: an initial that fits",
    "similar": "names {both}: same first name, close last names",
    "partial": "names {both}: only one name to compare",
    "family_differs": "same first name but different last names: {both}",
    "different": "different names: {both}",
    "shared": "both have {what}, but so do contacts with other names, so it counts for little",
    "phone": "same {kind} {what}",
    "tail": "same number if {local} is {intl} (one copy has no country code)",
    "no phone": "no number in common",
    "email": "same email {what}",
    "no email": "no email in common",
    "birthdays": "different birthdays",
    "birthday": "same birthday",
    "day": "same birthday (day and month)",
    "company": "same company",
}
TIERS = (("sure", 1.0), ("likely", 0.7), ("check", 0.4))
MAX_BLOCK = 300

# Public numbering plans: region, calling code, trunk prefix.
_REGIONS = """
US 1 1, CA 1 1, GB 44 0, IE 353 0, DE 49 0, AT 43 0, CH 41 0, FR 33 0, BE 32 0, NL 31 0, LU 352 -, ES 34 -, PT 351 -, IT 39 -,
DK 45 -, SE 46 0, NO 47 -, FI 358 0, IS 354 -, PL 48 -, CZ 420 -, SK 421 0, HU 36 06, RO 40 0, BG 359 0, GR 30 -, TR 90 0, RU 7 8, UA 380 0,
IN 91 0, PK 92 0, BD 880 0, LK 94 0, NP 977 0, CN 86 0, HK 852 -, TW 886 0, JP 81 0, KR 82 0, SG 65 -, MY 60 0, TH 66 0, VN 84 0, ID 62 0, PH 63 0,
AU 61 0, NZ 64 0, AE 971 0, SA 966 0, IL 972 0, EG 20 0, MA 212 0, NG 234 0, KE 254 0, ZA 27 0, BR 55 0, AR 54 0, CL 56 -, CO 57 -, MX 52 -, PE 51 0
"""
REGIONS = {r: (code, "" if trunk == "-" else trunk) for r, code, trunk in (x.split() for x in _REGIONS.replace("\n", " ").split(","))}
# Calling codes have one digit (1, 7), two digits (these), or else three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
