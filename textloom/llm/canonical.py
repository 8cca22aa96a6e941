"""One consistent form for text that looks the same (problem 6).

A quick check in the JVM passes rows whose characters are all of blocks that are certain. In the others the unstable
segments are isolated: the words around an unstable character, as composition and the choice of script need that much
context. Only they are normalised, and the results are spliced into the unchanged text. Which characters are unstable
follows from their Unicode properties: the normalization quick check (no or maybe), combining classes, the kind of
compatibility decomposition, and the categories of spaces and format characters.

The form: composed letters of ordinary width, letters of one script within a word, the plain space, the ASCII
apostrophe and hyphen, and nothing invisible. Accented letters, ellipsis, degree and section signs, and words wholly in
another script belong to it.

Defined results: null stays null and empty stays empty; the form of the form is the form; repeated rows are judged each
by itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.llm.arrow import strings

#: Letters of other scripts that look like Latin ones.
_CYRILLIC = ("АВСЕНІЈКМОРЅТХУҮаеіјорсухѕһԁԛԝћЋԌɡӀЬ", "ABCEHIJKMOPSTXYYaeijopcyxshdqwħĦGglb")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειικνορυχγϲ", "ABEZHIKMNOPTYXaeiiĸvopuxyc")
LOOKALIKE = dict(zip(_CYRILLIC[0], _CYRILLIC[1])) | dict(zip(_GREEK[0], _GREEK[1])) | {"κ": "k", "τ": "t", "м": "m", "т": "t", "в": "b", "н": "h", "к": "k", "г": "r", "п": "n", "и": "u", "η": "n", "ω": "w", "β": "b", "ѵ": "v", "ο": "o", "ı": "i"}
#: Characters that look like an apostrophe or a hyphen.
APOSTROPHES = "\u2018\u2019\u201b\u02bc\u02b9\u02bb\u2032\u00b4\uff07\u055a\ua78c\u05f3"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d\u02d7\u2043"
#: Ignorable characters that aren't of the category of format characters, and visible ones that are.
_IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\ufe00-\ufe0f\uffa0\U000e0000-\U000e0fff"
_VISIBLE = "[\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd\U00013430-\U0001345f]"
#: Letters of scripts that look-alikes come from, and two single letters.
_OTHER = "\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff\u0261\u0131"
#: Blocks with characters whose properties ask for a look; in all others (ideographs, syllables, private use) none is unstable.
_BLOCKS = ((0, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
#: Kinds of compatibility decomposition that are a matter of width or form alone.
_FORM_ONLY = ("<wide>", "<narrow>", "<font>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>", "<circle>")


def _is_maybe(ch: str, seconds: set[str]) -> bool:
    """Quick check "maybe": the character may combine with the one before it."""
    return unicodedata.combining(ch) > 0 or ch in seconds or "\u1161" <= ch <= "\u1175" or "\u11a8" <= ch <= "\u11c2"


def _is_form(ch: str) -> bool:
    """A character of unusual width or form, beyond Latin-1; signs such as the ellipsis stay what they are."""
    kind = unicodedata.decomposition(ch).split(" ", 1)[0]
    plain = unicodedata.normalize("NFKC", ch) if kind.startswith("<") else ""
    if not plain or ch < "\u0100" or " " in plain:
        return False
    return kind in _FORM_ONLY or (kind == "<compat>" and plain.isalpha() and (len(plain) == 1 or unicodedata.category(ch)[0] in "LN"))


def _class_of(codes: list[int]) -> str:
    """The inside of a character class for sorted code points."""
    out, at = [], 0
    while at < len(codes):
        to = at
        while to + 1 < len(codes) and codes[to + 1] == codes[to] + 1:
            to += 1
        out.append(re.escape(chr(codes[at])) + (f"-{re.escape(chr(codes[to]))}" if to > at else ""))
        at = to + 1
    return "".join(out)


def _properties() -> dict[str, list[int]]:
    """Code points of each kind of unstable characters."""
    every = [chr(c) for low, high in _BLOCKS for c in range(low, high) if not 0xD800 <= c < 0xE000]
    pairs = (unicodedata.decomposition(ch).split() for ch in every if not unicodedata.decomposition(ch).startswith("<"))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2}
    kinds: dict[str, list[int]] = {"space": [0x85], "format": [], "composition": [], "form": []}
    for ch in every:
        category = unicodedata.category(ch)
        if category in ("Zs", "Zl", "Zp") and ch != " ":
            kinds["space"].append(ord(ch))
        elif category == "Cf" and not re.match(_VISIBLE, ch):
            kinds["format"].append(ord(ch))
        elif _is_form(ch):
            kinds["form"].append(ord(ch))
        elif _is_maybe(ch, seconds) or not unicodedata.is_normalized("NFC", ch):
            kinds["composition"].append(ord(ch))
    return kinds


_KINDS = {name: _class_of(sorted(codes)) for name, codes in _properties().items()}
SPACES, INVISIBLE, WIDE = _KINDS["space"], _KINDS["format"] + _IGNORABLE, _KINDS["form"]
UNSTABLE = f"[{SPACES}{APOSTROPHES}{HYPHENS}{INVISIBLE}{WIDE}{_KINDS['composition']}{_OTHER}\u2013]"

_unstable = re.compile(UNSTABLE)
#: A segment: what stands between plain blanks.
_segment = re.compile(r"[^ \t\r\n]+")
_invisible = re.compile(f"[{INVISIBLE}]")
_spaces, _apostrophes, _hyphens = re.compile(f"[{SPACES}]"), re.compile(f"[{APOSTROPHES}]"), re.compile(f"[{HYPHENS}]|(?<=\\w)\u2013(?=\\w)(?!\\d)")
_wide = re.compile(f"[{WIDE}]")
_stroke = {"h\u0335": "ħ", "H\u0335": "Ħ", "d\u0335": "đ", "D\u0335": "Đ", "h\u0336": "ħ", "H\u0336": "Ħ"}
_strokes = re.compile("|".join(_stroke))
_word = re.compile(r"[^\W\d_]+")
_joined = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)+")
_other = re.compile(f"[{_OTHER}]")
_latin = re.compile("[A-Za-z\u00c0-\u024f]")
_looks = str.maketrans(LOOKALIKE)


def _one_script(match: re.Match) -> str:
    word = match.group()
    if not _other.search(word) or not _latin.search(word):
        return word
    return word.translate(_looks)


def _one_script_joined(match: re.Match) -> str:
    """Within a word of several parts, a part of look-alikes only follows the Latin parts; a single letter only after an apostrophe."""
    word = match.group()
    if not _other.search(word) or not _latin.search(word):
        return word

    def part(m: re.Match) -> str:
        own = m.group()
        after_apostrophe = m.start() > 0 and word[m.start() - 1] == "'"
        return own.translate(_looks) if (len(own) > 1 or after_apostrophe) and all(c in LOOKALIKE for c in own) else own

    return _word.sub(part, word)


def _pass(segment: str) -> str:
    s = _invisible.sub("", segment)
    s = _spaces.sub(" ", s)
    s = _wide.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    s = _strokes.sub(lambda m: _stroke[m.group()], s)
    s = unicodedata.normalize("NFC", s)
    s = _hyphens.sub("-", _apostrophes.sub("'", s))
    return _joined.sub(_one_script_joined, _word.sub(_one_script, s))


def _segment_form(segment: str) -> str:
    """Passes until nothing changes: a letter of one script may compose with a mark that the other's couldn't."""
    while (s := _pass(segment)) != segment:
        segment = s
    return s


def canonical_text(text: str) -> str:
    """The consistent form of a text; stable text is returned as it is."""
    if not _unstable.search(text):
        return text
    return _segment.sub(lambda m: _segment_form(m.group()) if _unstable.search(m.group()) else m.group(), text)


def _stable_class() -> str:
    """Java's class of characters beyond those that are certain: a few ranges, as it is tried on every character."""
    blocks = [range(0x250), (0x2014, 0x201C, 0x201D, 0x2026, 0x20AC), range(0x4E00, 0xA000), range(0xAC00, 0xD7A4)]
    codes = [c for block in blocks for c in block if not _unstable.match(chr(c))]
    ranges = []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


#: The quick check for the JVM; what it finds is looked at by all properties.
QUICK = _stable_class()


def is_unstable(column: Column) -> Column:
    """Whether a text has a character that may have to change."""
    return F.coalesce(column.rlike(QUICK), F.lit(False))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column(batch.num_columns - 1))
        forms = [canonical_text(t) for t in texts]
        changed = pa.array([a != b for a, b in zip(texts, forms)], pa.bool_())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, "form"]).filter(changed)


def changed(values: DataFrame) -> DataFrame:
    """Of values(..., text), the rows that aren't in the form, with ``form``."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)
    return values.where(is_unstable(F.col("text"))).mapInArrow(_forms, f"{kind}, form string")


def canonical(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the given text columns in the form; rows that pass the quick check stay in the JVM's hands."""
    form = F.pandas_udf(lambda s: s.map(lambda t: t if t is None else canonical_text(t)), StringType())
    for name in columns:
        df = df.withColumn(name, F.when(is_unstable(F.col(name)), form(F.when(is_unstable(F.col(name)), F.col(name)))).otherwise(F.col(name)))
    return df
