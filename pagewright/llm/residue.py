"""Template residue, filler, error and script-required pages, found with a multi-pattern automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import lexicon
from pagewright.llm.markup import Block, blocks

#: Elements whose text shows code.
CODE = frozenset("pre code kbd samp tt textarea".split())
#: Slots that hardly stand for anything else, and slots that do so only around a field's name; tried only where
#: the automaton has found an opener.
_NAME = r"[^\W\d][\w.\-]{0,40}"
SLOT = re.compile(
    rf"\{{\{{\s*[^\W\d][\w.\-| ]{{0,60}}\}}\}}|#\{{\s*{_NAME}\s*\}}|%%\s*{_NAME}\s*%%|%\({_NAME}\)[sdf]|<%[=-]?\s*@?{_NAME}\s*%>|@@{_NAME}@@|\[(?:insert|enter|add) [\w. ]{{2,50}}\]"
)
FIELD = re.compile(rf"\$?\{{\s*({_NAME})\s*\}}|__([A-Z][A-Z_.]*[A-Z])__|\[([A-Z][A-Z_.]{{2,40}})\]|\$([a-z][a-z_.]+)\$|«([a-z_]+(?:\.[a-z_]+)*)»")
_PART = re.compile(r"[._\-]+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_QUOTED = re.compile(r"[\"“”„‘’'`]")
_PATH = re.compile(r"\S*[/\\]\S*|\([^()]*#[^()]*\)")
_CUT = re.compile(r"(?<=[.!?。！？…)\]])\s+|(?<=[。！？])|\s+(?=(?:todo|tbd|tba|tbc|fixme)\b)")
_CLAUSE = re.compile(r"[.!?。！？;]")

COLUMNS = "slots int, filler double, notes double, message double, prose int, residue boolean"

#: Words of running text that a page's frame may have beside a message, and how many more each word of the message allows.
FRAME_WORDS, PER_WORD = 40, 10
#: Letters of a word's beginning by which inflected filler is known.
STEM = 4
_STEMS = frozenset(w[:STEM] for w in lexicon.FILLER_WORDS if len(w) >= STEM)
_LIVING = lexicon.FUNCTION_WORDS - lexicon.LATIN_FUNCTION_WORDS - lexicon.FILLER_WORDS


class Evidence(NamedTuple):
    """What was found on one page.

    ``slots`` unfilled slots outside code; ``filler``, ``notes`` and ``message`` the words of filler, of notes
    on missing text and of error or script messages, each over these words and those of ``prose``, the
    words of other running text.
    """

    slots: int
    filler: float
    notes: float
    message: float
    prose: int
    residue: bool


NOTHING = Evidence(0, 0.0, 0.0, 0.0, 0, False)


def automaton():
    """The automaton over all phrases and slot openers; values are (kinds, length)."""
    import ahocorasick

    kinds: dict[str, list[str]] = {}
    lists = (
        ("error", lexicon.ERROR_MESSAGES), ("script", lexicon.SCRIPT_WORDS), ("demand", lexicon.SCRIPT_DEMANDS), ("place", lexicon.SCRIPT_PLACES), ("widget", lexicon.WIDGETS), ("note", lexicon.FILLER_NOTES),
        ("state", lexicon.NOTE_STATES), ("filler", lexicon.FILLER_PHRASES), ("slot", lexicon.SLOT_OPENERS),
    )
    for kind, phrases in lists:
        for phrase in phrases:
            kinds.setdefault(phrase, []).append(kind)
    machine = ahocorasick.Automaton()
    for phrase, held in kinds.items():
        machine.add_word(phrase, (tuple(held), len(phrase)))
    machine.make_automaton()
    return machine


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reached = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, reached))
        reached = max(reached, b)
    return total


def _joins(a: str, b: str) -> bool:
    """Whether two characters belong to one word; scripts that do not part words have none."""
    return a.isalnum() and b.isalnum() and a < "\u2e80" and b < "\u2e80"


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a match neither starts nor ends inside a word."""
    before = start > 0 and _joins(text[start - 1], text[start])
    after = end < len(text) and _joins(text[end - 1], text[end])
    return not (before or after)


def _length(text: str) -> int:
    """Words of a text; scripts that do not part words count two characters for one."""
    wide = sum(c >= "\u2e80" for c in text)
    return len(_WORD.findall(text)) if not wide else len(_WORD.findall("".join(c if c < "\u2e80" else " " for c in text))) + (wide + 1) // 2


def filler_words(words: list[str]) -> int:
    """How many of a block's words are filler: all of them or none.

    Filler is Latin-like without the function words of any living language: 40 % of its words are of the
    standard vocabulary, or a tenth is and half begins like it, as inflected filler does. Or it is typed
    along the keyboard.
    """
    n = len(words)
    if n < 2:
        return sum(w in lexicon.FILLER_WORDS and w not in lexicon.ORDINARY_FILLER for w in words)
    held = [w for w in words if w in lexicon.FILLER_WORDS]
    kinds = set(held)
    living = sum(w in _LIVING for w in words)
    if len(kinds) >= 2 and not kinds <= lexicon.ORDINARY_FILLER and living <= 0.12 * n:
        begun = sum(w[:STEM] in _STEMS or w in lexicon.LATIN_FUNCTION_WORDS for w in words)
        if len(held) >= 0.4 * n or (n >= 12 and len(held) >= 0.1 * n and begun >= 0.5 * n):
            return n
    typed = [w for w in words if w in lexicon.TYPED_FILLER]
    return n if len(typed) >= 0.6 * n and len(set(typed)) >= 2 and living <= 0.12 * n else 0


def _slots(text: str, found: bool, subject: bool) -> tuple[int, int]:
    """Slots of a block that are surely meant to be filled, and those that are only in company."""
    if not found:
        return 0, 0

    def bare(m: re.Match) -> bool:
        return not (_QUOTED.match(text[m.start() - 1 : m.start()] or " ") and _QUOTED.match(text[m.end() : m.end() + 1] or " "))

    sure = sum(bare(m) for m in SLOT.finditer(text))
    weak = 0
    for m in FIELD.finditer(SLOT.sub(" ", text)):
        name = next(g for g in m.groups() if g).lower()
        parts = _PART.split(name)
        if not any(p in lexicon.FIELD_NAMES for p in parts):
            continue
        if len(parts) > 1 or m.group(0)[0] in "{_$":
            sure += 1
        else:
            weak += 1
    return (0, 0) if subject else (sure, weak)


def _sentence(text: str, hits: dict[str, list[tuple[int, int]]], share: float) -> str | None:
    """What a sentence is, ``message`` or ``note``, if it is either.

    A message if its phrases cover ``share`` of it, paths, references and numbers left out, or if it names
    scripts and demands them for the page, not for a part of it, in thirty words at most; no question is. A
    note if it begins with a mark, or is short and says of a text, a picture or the like that it is still missing.
    """
    if text.rstrip().endswith(("?", "？")):
        return None
    words = _WORD.findall(text)
    bare = len(_PATH.sub("", text).strip()) or 1
    if hits["error"] and _covered(hits["error"]) >= share * bare:
        return "message"
    if hits["script"] and hits["demand"] and len(words) <= 30 and not hits["widget"] and (hits["place"] or any("java" in text[a:b] for a, b in hits["script"])):
        return "message"
    if words and words[0] in lexicon.NOTE_MARKS and 1 < len(words) <= 12:
        return "note"
    if hits["note"] and len(words) <= 12 and (_covered(hits["note"]) >= 0.3 * bare or len(words) < 9):
        return "note"
    if hits["state"] and len(words) <= 10 and any(w in lexicon.NOTE_SUBJECTS for w in words):
        return "note"
    return None


def judge(page: list[Block], machine, message_share: float = 0.25) -> Evidence:
    """Evidence of one page's blocks, and whether it is residue.

    Residue is any unfilled slot; filler or notes that make up a part of the page (12 words of filler, two
    notes, unless running text names the filler as its subject); or filler, a note or messages that are
    long against the page's running text: of that there may be as much as a frame has and ten words for
    each of theirs. Notes and messages count in blocks that are mostly that. Blocks of code count for nothing, titles for slots only.
    """
    sure = weak = prose = 0
    filler, largest, notes, note_words, message_words = 0, 0, 0, 0, 0
    subject = False
    for b in page:
        if b.tag in CODE:
            continue
        text = _DIGITS.sub("#", b.text.lower())
        words = _WORD.findall(text)
        found = False
        hits: list[tuple[int, int, str]] = []
        for end, (kinds, n) in machine.iter(text):
            for kind in kinds:
                if kind == "slot":
                    found = True
                elif _whole(text, end - n + 1, end + 1):
                    hits.append((end - n + 1, end + 1, kind))
        a, w = _slots(b.text, found, any(x in lexicon.SLOT_SUBJECTS for x in words))
        sure, weak = sure + a, weak + w
        if not words or b.tag == "title":
            continue
        mine = filler_words(words)
        if mine or any(kind == "filler" for *_, kind in hits):
            mine = mine or len(words)
            filler, largest = filler + mine, max(largest, mine)
            continue
        told = told_message = told_notes = told_note = 0
        if hits or words[0] in lexicon.NOTE_MARKS:
            at = 0
            short = len(words) <= 30 and "?" not in text and {"script", "demand"} <= {kind for *_, kind in hits}
            for cut in [*(() if short else (m.span() for m in _CUT.finditer(text))), (len(text), len(text))]:
                piece = text[at : cut[0]]
                inside: dict[str, list[tuple[int, int]]] = {k: [] for k in ("error", "script", "demand", "place", "widget", "note", "state", "filler")}
                for x, y, kind in hits:
                    if at <= x and y <= cut[0]:
                        inside[kind].append((x, y))
                kind = _sentence(piece, inside, message_share)
                if kind:
                    length = _length(piece)
                    told += length
                    if kind == "message":
                        told_message += length
                    else:
                        told_notes, told_note = told_notes + 1, told_note + length
                at = cut[1]
        if told * 2 >= _length(text):
            message_words, notes, note_words = message_words + told_message, notes + told_notes, note_words + told_note
            continue
        function = sum(w in lexicon.FUNCTION_WORDS for w in words)
        if len(words) >= 12 and function >= 0.18 * len(words) and not b.linked > 0.5 * len(b.text) and b.text[-1:] in ".?!":
            prose += len(words)
            subject = subject or "lorem" in words or "ipsum" in words
    slots = sure + weak if sure or weak > 1 else 0
    own = lambda n: n > 0 and prose <= FRAME_WORDS + PER_WORD * n
    part = (filler >= 12 and not (subject and largest < 12)) or notes >= 2
    residue = slots > 0 or part or (filler >= 4 and own(filler)) or own(note_words) or own(message_words)
    over = lambda n: n / (n + prose) if n else 0.0
    return Evidence(slots, over(filler), over(note_words), over(message_words), prose, residue)


def page_residue(pages: DataFrame, key: str = "docid", content: str = "content") -> DataFrame:
    """Evidence of template residue for each page: ``key`` and the columns of :class:`Evidence`.

    One row a distinct key; of repeated or differing rows with one key the strongest evidence stays.
    Rows with a null key are left out; null, empty and white-space contents have no evidence. Texts of
    any length are read whole. Other columns are not looked at; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for batch in batches:
            rows = [judge(blocks(c), machine) if isinstance(c, str) and c.strip() else NOTHING for c in batch["content"]]
            yield pd.concat([batch[["key"]].reset_index(drop=True), pd.DataFrame(rows, columns=Evidence._fields)], axis=1)

    kind = pages.schema[key].dataType.simpleString()
    chosen = pages.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"))
    seen = chosen.mapInPandas(run, f"key {kind}, {COLUMNS}")
    strongest = [F.max(c).alias(c) for c in ("slots", "filler", "notes", "message", "prose", "residue")]
    return seen.groupBy(F.col("key").alias(key)).agg(*strongest)


def without_residue(pages: DataFrame, key: str = "docid", content: str = "content") -> DataFrame:
    """The pages that show no residue, with all their columns and repeated rows."""
    flagged = page_residue(pages, key, content).filter("residue").select(key)
    return pages.join(flagged, key, "left_anti")
