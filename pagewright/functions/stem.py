"""Porter's stemmer as SQL, for Spark and for the SQL it is checked against.

Written from the published algorithm (1980) with the extensions that common libraries make: words of up
to two letters and a few irregular ones stay as listed, "-ies" and "-ied" of four letters keep their e,
"-bli", "-fulli" and "-logi" have rules of their own. A y that stands for a consonant is written Y
meanwhile, so vowels and consonants are two classes of letters.
"""

from __future__ import annotations

from collections.abc import Callable

V, C = "[aeiouy]", "[^aeiouy]"
#: At least one, two vowel-consonant turns at the start of what stands before a suffix.
M1, M2 = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}"
SHORT = f"({C}{V}[^aeiouywxY]|^{V}{C})"

# Irregular words.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffixes and what replaces them, in the order of trial.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Marks a word that has lost "ed" or "ing".
MARK = "\x02"

Test = Callable[[str, str], str]


def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _cut(n: int, more: str = "") -> str:
    cut = f"left(w, length(w) - {n})" if n else "w"
    return f"concat({cut}, '{more}')" if more else cut


def _rules(rules: list[tuple[str, str, str]]) -> str:
    """The first suffix that fits decides: (suffix, condition, result)."""
    whens = " ".join(f"WHEN {_ends(s)} THEN CASE WHEN {cond} THEN {result} ELSE w END" for s, cond, result in rules)
    return f"CASE {whens} ELSE w END"


def steps(test: Test, sub: Callable[[str, str, str], str]) -> list[str]:
    """Expressions over a column ``w``, each to be applied to the one before's result.

    ``test(value, pattern)`` and ``sub(value, pattern, replacement)`` write a dialect's regular
    expressions. ``w0`` is the word itself.
    """
    m1 = lambda s: test("w", f"{M1}.*{s}$")
    m2 = lambda s: test("w", f"{M2}.*{s}$")
    marked = sub(sub("w0", "^y", "Y"), "([aeiou])y", "{1}Y")
    s1a = f"CASE WHEN {_ends('sses')} THEN {_cut(2)} WHEN {_ends('ies')} THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END WHEN {_ends('ss')} THEN w WHEN {_ends('s')} THEN {_cut(1)} ELSE w END"
    # A word that loses "ed" or "ing" is handed on with a mark, so that the next step may mend its end.
    s1b = (
        f"CASE WHEN {_ends('ied')} THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END "
        f"WHEN {_ends('eed')} THEN CASE WHEN {m1('eed')} THEN {_cut(1)} ELSE w END "
        f"WHEN {test('w', f'{V}.*ed$')} THEN concat({_cut(2)}, '{MARK}') WHEN {test('w', f'{V}.*ing$')} THEN concat({_cut(3)}, '{MARK}') ELSE w END"
    )
    double = "(" + "|".join(f"{c}{c}" for c in "bcdfghjkmnpqrtvwxY0123456789") + f"){MARK}$"
    any_double = f"(ll|ss|zz){MARK}$"
    mend = (
        f"CASE WHEN right(w, 1) <> '{MARK}' OR length(w) < 2 THEN w WHEN {test('w', f'(at|bl|iz){MARK}$')} THEN {_cut(1, 'e')} "
        f"WHEN {test('w', double)} THEN {_cut(2)} WHEN {test('w', any_double)} THEN {_cut(1)} "
        f"WHEN {test('w', f'^{C}*{V}+{C}+{V}*{MARK}$')} AND {test('w', f'{SHORT}{MARK}$')} THEN {_cut(1, 'e')} ELSE {_cut(1)} END"
    )
    s1c = f"CASE WHEN {test('w', f'^.+{C}y$')} THEN {_cut(1, 'i')} ELSE w END"
    alli = f"CASE WHEN {_ends('alli')} AND {m1('alli')} THEN {_cut(2)} ELSE w END"
    s2 = _rules([(s, m1(s), _cut(len(s), r)) for s, r in STEP2] + [("logi", m1("ogi"), _cut(1))])
    s3 = _rules([(s, m1(s), _cut(len(s), r)) for s, r in STEP3])
    s4 = _rules([(s, m2(s) if s != "ion" else f"{m2('ion')} AND {test('w', '[st]ion$')}", _cut(len(s))) for s in STEP4])
    s5a = f"CASE WHEN {_ends('e')} AND ({m2('e')} OR ({test('w', f'^{C}*{V}+{C}+{V}*e$')} AND NOT {test('w', f'{SHORT}e$')})) THEN {_cut(1)} ELSE w END"
    s5b = f"CASE WHEN {_ends('ll')} AND {m2('l')} THEN {_cut(1)} ELSE w END"
    irregular = " ".join(f"WHEN w0 = '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    last = f"CASE {irregular} WHEN length(w0) <= 2 THEN w0 ELSE replace(w, 'Y', 'y') END"
    return [marked, s1a, s1b, mend, s1c, alli, s2, s3, s4, s5a, s5b, last]
