"""Garbled text from wrong character encoding (problem 1).

1. The words of all fields are counted. Their key is the word stripped of non-ASCII characters, with a mark at each place
   where some were stripped.
2. The alphabet comes from the corpus: letters of the main script that stand alone between ASCII characters, unless most
   of their words have a much more frequent twin (a word of the same key). Words in that alphabet are clean.
3. Garbled words are joined with their clean near-twins by the key. Between two ASCII characters the garbled run stands for
   the clean one, which gives pairs of sequence and letter with the number of words that show them.
4. Sequences with enough support are learned from these pairs as they are. Where the pairs show several letters of a known
   transformation (written in one encoding, read in another, of all that Python knows), it extends the mapping to the
   letters and signs of the corpus that no pair shows. The mapping is then applied to all values, twins or not.
5. Lost letters (replacement characters, and question marks where clean words have a letter between the same neighbours)
   are restored from the twin that stands most often, where there is one.

Defined results: null and empty values are never garbled; repeated rows are judged each by itself; letters and signs of
other languages that belong to the text are left alone; a value that can't be restored wholly is flagged all the same.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from encodings.aliases import aliases
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import strings
from textloom.llm.canonical import LOOKALIKE, canonical_text
from textloom.session import cut

#: Letters beyond ASCII of the languages of the tables; only for readers that see one text at a time. Problem 1 takes its letters from the corpus.
LETTERS = "ħġċżĦĠĊŻàèìòùÀÈÌÒÙéÉ"
LOST = "�"
#: Encodings in which text of these languages is most often misread. Fixed names of public encodings.
READ = ("cp1252", "latin-1", "cp1250", "mac-roman", "cp437", "cp850", "iso8859-15", "cp1254", "cp1257")
#: Those as Python's own names for them, which the list of all encodings has.
COMMON = frozenset(codecs.lookup(name).name for name in READ)
MIN_SUPPORT = 2
#: Words that must show a sequence that no known transformation explains.
ALONE_SUPPORT = 4
#: A letter is garbled if more than half of its words have a twin that stands so many times as often.
DOMINATED = 5
#: A letter that stands less often than this share of the most frequent one is foreign: left alone, but no clean letter.
RARE = 0.001

_PUNCTUATION = r"""^["(\[{<>*_]+|["'.,;:!)\]}<>*_]+$"""


def read_as(letter: str, written: str, read: str) -> str | None:
    """What ``letter`` looks like when its bytes are read in the wrong encoding; undefined bytes stay controls."""
    try:
        octets = letter.encode(written)
    except UnicodeEncodeError:
        return None
    out = []
    for octet in octets:
        try:
            out.append(bytes([octet]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(octet))
    return "".join(out)


@cache
def charmaps() -> tuple[str, ...]:
    """All encodings of one byte a character with ASCII in them that Python knows."""
    found, seen = [], set()
    for name in sorted({*aliases.values()}):
        try:
            ascii_part = bytes(range(32, 127)).decode(name)
            table = tuple(bytes([c]).decode(name, "replace") for c in range(128, 256))
        except (LookupError, UnicodeError):
            continue
        if ascii_part == bytes(range(32, 127)).decode("ascii") and all(len(x) == 1 for x in table) and table not in seen and sum(x == LOST for x in table) < 64:
            seen.add(table)
            found.append(codecs.lookup(name).name)
    return tuple(found)


def transformations(letters: str = LETTERS, written: Iterable[str] = ("utf-8",), read: Iterable[str] = READ) -> dict[tuple[str, ...], dict[str, str]]:
    """For each way to go wrong once or (from UTF-8) twice: letter -> garbled sequence."""
    found = {}
    for wrote in written:
        for reads in read:
            if wrote == reads:
                continue
            once = {c: g for c in letters if (g := read_as(c, wrote, reads)) and g != c}
            found[wrote, reads] = once
            if wrote == "utf-8":
                found[wrote, reads, "twice"] = {c: "".join(read_as(x, wrote, reads) or x for x in g) for c, g in once.items()}
    return found


@dataclass(frozen=True)
class Mapping:
    """Learned sequences and the letters that they stand for, the alphabet, and the surroundings of its letters."""

    letters: dict[str, str]
    alphabet: str = LETTERS
    surroundings: frozenset[str] = frozenset()

    def pattern(self) -> re.Pattern:
        several = sorted((g for g in self.letters if len(g) > 1), key=len, reverse=True)
        return re.compile("|".join(map(re.escape, several)) or r"(?!)")

    def single(self) -> dict[str, str]:
        return {g: c for g, c in self.letters.items() if len(g) == 1}

    def suspect(self) -> str:
        """Values that need a look: any character that isn't plain ASCII, a clean letter or an ellipsis, or a lost letter."""
        return rf"[^\x00-\x7F{self.alphabet}…]|\?[\p{{L}}\p{{Nd}}\-?]|\p{{L}}\? \p{{Ll}}"


def _may_be_garbled(sequence: str, alphabet: str) -> bool:
    """Whether a sequence can have come from a wrong decoding rather than from look-alike or invisible characters."""
    if LOST in sequence or "?" in sequence or all(c in alphabet or c == "…" for c in sequence):
        return False
    # What is left without invisible characters, marks, blanks and wide forms must be strange, too; beside a clean letter also without look-alikes.
    rest = [c for c in sequence if unicodedata.category(c) not in ("Cf", "Mn", "Zs") and not "\uff00" <= c <= "\uffef"]
    if any(c in alphabet for c in sequence):
        rest = [c for c in rest if c not in LOOKALIKE and c not in alphabet and c != "…"]
    if not rest:
        return False
    return len(sequence) > 1 or sequence not in LOOKALIKE


def learn(units: Iterable[tuple[str, str, int]], alphabet: str = LETTERS, signs: str = "", min_support: int = MIN_SUPPORT, read: Iterable[str] | None = None) -> Mapping:
    """The mapping from units (garbled sequence, letter, words that show it)."""
    shown = {(g, c): n for g, c, n in units if g != c and _may_be_garbled(g, alphabet)}
    votes: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for (garbled, letter), n in shown.items():
        votes[garbled][letter] += n
    written = ("utf-8", *(w for w in charmaps() if sum(read_as(c, w, "latin-1") is not None for c in alphabet) >= max(4, len(alphabet) // 2)))
    ways = transformations(alphabet + signs, written, charmaps() if read is None else read)
    explained: set[tuple[str, str]] = set()

    def extend(way: tuple[str, ...]) -> None:
        letters = ways.pop(way)
        support = sum(shown.get((g, c), 0) for c, g in letters.items())
        for c, g in letters.items():
            if _may_be_garbled(g, alphabet):
                votes[g][c] += support
                explained.add((g, c))

    shows = lambda way: [shown[g, c] for c, g in ways[way].items() if (g, c) in shown]
    # The common transformations of which several letters are shown; of all others those that show what none before does.
    for way in [w for w in ways if w[1] in COMMON and len(shows(w)) >= 2 and sum(shows(w)) >= min_support]:
        extend(way)
    while True:
        new = {w: sum(n for c, g in letters.items() if (n := shown.get((g, c), 0)) >= min_support and (g, c) not in explained) for w, letters in ways.items() if len(shows(w)) >= 2}
        best = max(new, key=lambda w: (new[w], sum(shows(w)), "twice" not in w, w), default=None)
        if best is None or not new[best]:
            break
        extend(best)
    chosen = {}
    for garbled, by in votes.items():
        total = sum(by.values())
        letter, n = max(by.items(), key=lambda x: (x[1], x[0]))
        if (garbled, letter) not in explained and (total < ALONE_SUPPORT or (len(garbled) == 1 and garbled.isalpha())):
            continue
        if n >= min_support and n >= 0.6 * total and (len(garbled) > 1 or letter in alphabet):
            chosen[garbled] = letter
    return Mapping(chosen, alphabet)


def words(values: DataFrame) -> DataFrame:
    """(word, n) of the words with a character beyond ASCII or a question mark within, from values(text)."""
    spread = values.where(F.col("text").rlike(r"[^\x00-\x7F]|\?\p{L}")).select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("word"))
    spread = spread.where(F.col("word").rlike(r"[^\x00-\x7F]|\?\p{L}")).select(F.regexp_replace("word", _PUNCTUATION, "").alias("word"))
    return spread.groupBy("word").agg(F.count("*").alias("n"))


_MARK = "\x01"
_RUN = r"[^\x00-\x3E\x40-\x7F]+"
_ALONE = r"(?<![^\x00-\x7F])[^\x00-\x7F](?![^\x00-\x7F])"


def keyed(counted: DataFrame) -> DataFrame:
    """Words without digits with their key: stripped of non-ASCII characters, a mark at each place; at least two letters stay."""
    rows = counted.where(~F.col("word").rlike(r"\p{Nd}")).withColumn("key", F.regexp_replace("word", _RUN, _MARK))
    return rows.where(F.length(F.replace("key", F.lit(_MARK), F.lit(""))) >= 2)


def alphabet_of(counted: DataFrame) -> tuple[str, str]:
    """(letters, signs) that the corpus itself is written with; the tables collected have a row a character at most."""
    rows = keyed(counted)
    top = rows.groupBy("key").agg(F.max("n").alias("top"))
    alone = F.array_distinct(F.regexp_extract_all("word", F.lit(_ALONE), F.lit(0)))
    below = rows.where(F.col("word").rlike(_ALONE)).join(top, "key").select(F.explode(alone).alias("c"), (F.col("n") * DOMINATED <= F.col("top")).cast("int").alias("below"), "n")
    by = below.groupBy("c").agg(F.avg("below").alias("below"), F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    least = max([RARE * r["n"] for r in by if r["c"].isalpha()], default=0)
    own = {r["c"]: r["n"] for r in by if r["below"] <= 0.5 and r["n"] >= least and unicodedata.category(r["c"])[0] in "LSPN" and r["c"] != LOST}
    scripts: dict[str, int] = defaultdict(int)
    for c, n in own.items():
        if c.isalpha():
            scripts[unicodedata.name(c, "?").split()[0]] += n
    main = max(scripts, key=lambda s: (scripts[s], s), default="LATIN")
    letters = {c for c in own if c.isalpha() and unicodedata.name(c, "?").startswith(main) and canonical_text(c) == c}
    letters |= {x for c in letters for x in (c.upper(), c.lower()) if len(x) == 1}
    letters -= {r["c"] for r in by if r["below"] > 0.5}
    foreign = counted.where(F.col("word").rlike(r"^[\p{L}&&[^\p{IsLatin}]]{3,}$")).select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    bare = counted.where(F.col("word").rlike(_ALONE)).select(F.explode(F.regexp_extract_all("word", F.lit(_ALONE), F.lit(0))).alias("c")).distinct().collect()
    garbled = {r["c"] for r in by if r["below"] > 0.5}
    signs = {r["c"] for r in (*foreign, *bare) if r["c"] and unicodedata.category(r["c"])[0] in "LSPN"} - letters - garbled - {LOST}
    return "".join(sorted(letters)), "".join(sorted(signs | {"…"}))


def _clean(alphabet: str) -> str:
    return rf"^[\x00-\x3E\x40-\x7F{alphabet}]+$"


def twins(counted: DataFrame, alphabet: str = LETTERS) -> DataFrame:
    """Garbled words with the clean words of their key."""
    rows = keyed(counted)
    is_clean = F.col("word").rlike(_clean(alphabet))
    clean = rows.where(is_clean & F.col("key").contains(_MARK)).select("key", F.col("word").alias("twin"), F.col("n").alias("twin_n"))
    return rows.where(~is_clean).join(clean, "key")


def units(twin_rows: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(garbled, letter, n): sequences that stand for one letter and the number of garbled words that show it, at least ``min_support``.

    A run that stands for several letters is divided evenly. Every unit above the support is kept; they are the model.
    """
    split = r"[\x00-\x3E\x40-\x7F]"
    aligned = twin_rows.select("word", F.explode(F.arrays_zip(F.split("word", split, -1).alias("g"), F.split("twin", split, -1).alias("c"))).alias("z")).select("word", "z.g", "z.c")
    aligned = aligned.where("g <> c and c <> '' and char_length(g) % char_length(c) = 0").withColumn("k", F.expr("char_length(g) div char_length(c)"))
    each = F.transform(F.sequence(F.lit(1), F.char_length("c")), lambda i: F.struct(F.substring("g", ((i - 1) * F.col("k") + 1).cast("int"), F.col("k").cast("int")).alias("garbled"), F.substring("c", i, F.lit(1)).alias("letter")))
    single = aligned.select("word", F.explode(each).alias("u")).select("word", "u.garbled", "u.letter").where("garbled <> letter").distinct()
    return single.groupBy("garbled", "letter").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)


def surroundings(counted: DataFrame, alphabet: str, signs: str) -> list[str]:
    """The neighbours of clean non-ASCII characters as "ab?cd": two ASCII characters a side in lower case, so that there are less than 45**4 of them."""
    row = F.concat(F.lit("^"), F.regexp_replace(F.lower(F.regexp_replace("word", f"[^\\x00-\\x7F{alphabet}{re.escape(signs)}]", _MARK)), r"\p{Nd}", "0"), F.lit("$"))
    rows = counted.select(row.alias("w")).where(~F.col("w").contains(_MARK) & ~F.col("w").contains("?"))
    at = F.filter(F.sequence(F.lit(2), F.char_length("w") - 1), lambda i: ~F.substring("w", i, F.lit(1)).between("\x00", "\x7f"))
    found = rows.select("w", F.explode(at).alias("i")).select(F.concat(F.expr("substring(w, greatest(1, i - 2), least(2, i - 1))"), F.lit("?"), F.expr("substring(w, i + 1, 2)")).alias("s"))
    return [r["s"] for r in found.where(F.col("s").rlike(r"^[\^a-z0'\-]{1,2}\?[a-z0'\-$]{1,2}$")).distinct().collect()]


_LETTER = r"[^\W\d_]"
#: A question mark for a letter or sign: within a word, before one or a number, or after one with the sentence going on.
_QUESTION = re.compile(rf"(?<=[ (])\?(?=\d)|(?<={_LETTER})\?(?={_LETTER})|(?:(?<=^)|(?<=[\s\"(\-?]))\?(?=\??{_LETTER})|(?<={_LETTER})\?(?=-{_LETTER})|(?<={_LETTER})\?(?= [a-z]+ )(?![^.!?]*\" )")
_WORD = re.compile(r"[^ \t\r\n]+")
_edges = re.compile(r"""^["'(\[{<>*_\-]+|["'.,;:!)\]}<>*_\-]+$""")
_URL = re.compile(r"\S*(?:https?://|www\.)\S*", re.I)


class Repair:
    """Applies a mapping to values."""

    def __init__(self, mapping: Mapping) -> None:
        self.letters, self.several, self.single, self.surroundings = mapping.letters, mapping.pattern(), mapping.single(), mapping.surroundings
        leads = {g[0] for g in mapping.letters if len(g) > 1 and g[0] not in mapping.alphabet}
        self.cut = re.compile(rf"(?:[{re.escape(''.join(sorted(leads)))}])(?=$|\.\.\.$)") if leads else re.compile(r"(?!)")
        self.alone = re.compile("[" + re.escape("".join(self.single)) + "]") if self.single else re.compile(r"(?!)")
        self.possible = re.compile(rf"[A-Za-z{mapping.alphabet}'\-]*")

    def word(self, word: str) -> str:
        """Repair of single characters, where all of the repaired word is written in the clean alphabet."""
        if not self.alone.search(word):
            return word
        core = re.sub(r"""^[^\w±¿¡]+|[^\w±¿¡]+$""", "", word)
        if not core or any(c.isdigit() for c in core) or not re.search(r"[A-Za-z]", core):
            return word
        fixed = "".join(self.single.get(c, c) for c in core)
        return word.replace(core, fixed, 1) if fixed != core and self.possible.fullmatch(fixed) else word

    def question(self, text: str) -> bool:
        """Whether a question mark stands where clean words have a letter or sign between the same neighbours."""
        for m in _QUESTION.finditer(text):
            start = max(text.rfind(c, 0, m.start()) for c in " \t\r\n") + 1
            word = "^" + re.sub(r"\d", "0", _edges.sub("", _WORD.match(text, start).group()).lower()) + "$"
            for at in (i for i, c in enumerate(word) if c == "?"):
                before, after = word[max(0, at - 2) : at], word[at + 1 : at + 3]
                if f"{before}?{after}" in self.surroundings or "?" in before + after:
                    return True
        return False

    def text(self, text: str) -> tuple[bool, str, bool]:
        """(garbled, repaired text, letters lost) of a value."""
        fixed = text
        for _ in range(3):  # text may have gone wrong more than once
            again = self.several.sub(lambda m: self.letters[m.group()], fixed)
            if again == fixed:
                break
            fixed = again
        fixed = _WORD.sub(lambda m: self.word(m.group()), fixed)
        lost = LOST in text or ("?" in text and self.question(_URL.sub("", text)))
        cut = bool(self.cut.search(text))
        return fixed != text or lost or cut, fixed, lost


def _apply(mapping: Mapping, keep_garbled: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(mapping)
        for batch in batches:
            judged = [repair.text(t) for t in strings(batch.column(batch.num_columns - 1))]
            keep = pa.array([j[0] == keep_garbled for j in judged], pa.bool_())
            columns = [*batch.columns, pa.array([j[1] for j in judged], pa.string()), pa.array([j[2] for j in judged], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "repaired", "lost"]).filter(keep)

    return run


def fields(tables: dict[tuple[str, str], DataFrame], id_column: str = "row_id") -> DataFrame:
    """(table_name, field_name, row_id, text) of the given (table, field) -> rows."""
    parts = [rows.select(F.lit(t).alias("table_name"), F.lit(f).alias("field_name"), F.col(id_column).alias("row_id"), F.col(f).alias("text")) for (t, f), rows in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def learned(values: DataFrame) -> Mapping:
    """The mapping that all ``values`` show."""
    return _learned(cut(words(values)))[0]


def _learned(counted: DataFrame) -> tuple[Mapping, DataFrame]:
    alphabet, signs = alphabet_of(counted)
    twin_rows = twins(counted, alphabet)
    mapping = learn([tuple(r) for r in units(twin_rows).collect()], alphabet, signs)
    return replace(mapping, surroundings=frozenset(surroundings(counted, alphabet, signs))), twin_rows


def garbled(values: DataFrame, mapping: Mapping) -> DataFrame:
    """Garbled values with ``repaired`` and whether letters are lost in them."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema)
    return values.where(F.col("text").rlike(mapping.suspect())).mapInArrow(_apply(mapping), f"{kind}, repaired string, lost boolean")


def not_garbled(values: DataFrame, mapping: Mapping, exempt: set[str]) -> DataFrame:
    """Values that aren't garbled, and all of the tables ``exempt``."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema)
    clean = values.where(~F.col("table_name").isin(*exempt)).mapInArrow(_apply(mapping, False), f"{kind}, repaired string, lost boolean")
    return clean.drop("repaired", "lost").unionByName(values.where(F.col("table_name").isin(*exempt)))


def restored(values: DataFrame) -> DataFrame:
    """(table_name, field_name, row_id, repaired, complete): lost letters are taken from the most frequent twin."""
    mapping, twin_rows = _learned(cut(words(values)))
    found = garbled(values, mapping)
    lost_twins = twin_rows.where(F.col("word").rlike(f"[{LOST}?]"))
    best = lost_twins.groupBy("word").agg(F.min_by("twin", F.struct((-F.col("twin_n")).alias("n"), "twin")).alias("twin"))
    key = ["table_name", "field_name", "row_id"]
    spread = found.where("lost").select(*key, F.posexplode(F.split("repaired", " ")).alias("pos", "raw")).withColumn("word", F.regexp_replace("raw", _PUNCTUATION, ""))
    fixed = spread.join(best, "word", "left").withColumn("raw", F.when(F.col("twin").isNotNull(), F.replace("raw", F.col("word"), F.col("twin"))).otherwise(F.col("raw")))
    whole = fixed.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), " ").alias("repaired"))
    whole = whole.withColumn("complete", ~F.col("repaired").rlike(rf"{LOST}|\p{{L}}\?\p{{L}}"))
    return found.where("not lost").select(*key, "repaired", F.lit(True).alias("complete")).unionByName(whole)
