"""Personal information inside free text (problem 2), by bootstrapped contextual extraction.

1. Candidates of all kinds are cut out of the texts with the words on either side: anything that may be written as an
   e-mail address, numbers, a house number beside words (whatever the street is called), and pairs of words of which one
   is a listed name. Self-evident ones are seeds: plain addresses with @, numbers with a country code or a check letter,
   streets of the few types in ``SEED_TYPES``, pairs of a listed given name and surname.
2. Seeds induce patterns: the words left and right, the shape, the domain, the word for the kind of street, the half of a
   name that the list lacks. Spark scores the one graph of patterns and candidates in rounds: a pattern is as good as the
   candidates in it, a candidate as good as its patterns. Patterns of a text's beginning and end alone say nothing.
3. Good patterns discover what no list or shape shows: other spellings of addresses, other kinds of streets, bare
   numbers. For names the left contexts are looked for in the texts, also where neither half is listed; words discovered
   so complete pairs of which the list has one half, these bring new contexts, and so on until none is new.

Texts are matched in their consistent form, so that look-alike characters hide nothing; replacing leaves the rest of a
text as it was. Items that a cut text breaks off are none: at the end of an open text an item counts only if its
domain, street, shape or name stands whole elsewhere.

Defined results: null and empty texts hold nothing; repeated rows are judged each by itself; names within addresses of
e-mail are none; overlapping items are replaced as one, by the kind that starts first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import strings
from textloom.llm.canonical import canonical_text
from textloom.llm.encoding import transformations
from textloom.session import cut

ROUNDS = 3
#: Scores from which a candidate is accepted. Few things but addresses are written with an at and a dot; a street address has several overlapping candidates, of which each has a share of its contexts.
ACCEPT = {"email": 0.25, "phone": 0.5, "id_number": 0.5, "address": 0.1}
#: Left contexts of at least this many known names are looked for, where names follow in at least this share.
MIN_SEEDS, WORTH = 3, 0.25
#: Up to so many contexts and names are sent to the workers; more are joined as tables.
SENT_ROWS = 200_000
#: Words for streets that the seeds are found by; all others are learned.
SEED_TYPES = frozenset(("triq", "via", "street", "road"))
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|(?=\sat\s[\w-]+(?:\sdot\s[\w-]+)+)\sat\s|\s(?:chiocciola)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s(?:dot|punt|punto)\s)"
EMAIL = re.compile(rf"[^\W_][\w.+-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*{_DOT}[^\W\d_]{{2,}}", re.I)
_domain = re.compile(rf"{_AT}(.*)", re.I | re.S)
_first_at = re.compile(_AT, re.I)
_plain_mail = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_at_word = re.compile(r"\bat\b|chiocciola", re.I)
NUMBER = re.compile(r"(?<![\w.@/+-])(?:\(\+\d{1,3}\) ?|\+|[A-Z]{2}[- ]?)?\d(?:[ .\-]?\d){4,14}(?:[- ]?\([A-Za-z]\)|(?:[A-Za-z]|[- ][A-Z])(?![\w']))?(?![\w/])|(?<![\w.@/+-])\d{3,4}[- ]?(?:\([A-Z]\)|[A-Z](?![\w'.]))")
_phone_seed = re.compile(r"^(?:\(?\+\d[\d .()\-]*|00\d{3} ?[\d .\-]{8,12})$")
_id_seed = re.compile(r"^(?:\d{5,7}[- ]?\(?[A-Za-z]\)?|[A-Z]{2}[- ]?\d{6,8})$")
_STREET = r"(?:(?:(?:i[lcċdnrstxzż]|l|tal|ta[dnrstxzż])-|ta' |san |santa |sidi )[^\W\d_]+(?:['’-][^\W\d_]+)*|[^\W\d_]{2,}(?: [A-ZĦĊĠŻ][^\W\d_]+)?)"
_HOUSE = r"\d{1,4}[A-Za-z]?(?:/\d{1,4}[A-Za-z]?)?(?!\w)"
_FLAT = rf"(?:flat|fl\.?|apt\.?|appartament) ?{_HOUSE},? ?(?:(?:blokk|block) ?\w{{1,3}},? ?)?"
#: A house number before a word and a name, after them, and before capitalised words; the word for the street may be any.
ADDRESS = {
    "front": re.compile(rf"(?i:{_FLAT}|{_HOUSE}),? ?(?:{_HOUSE},? )?(?P<t>[^\W\d_]{{3,}}) (?P<s>(?i:{_STREET}))"),
    "back": re.compile(rf"(?P<t>[^\W\d_]{{3,}}) (?P<s>(?i:{_STREET})),? (?i:nru\.?|numru|no\.?|n\.|n°)? ?{_HOUSE}"),
    "title": re.compile(rf"{_HOUSE},? (?P<s>(?:[A-ZĦĊĠŻ][\w']+ ){{1,3}}?)(?P<t>[A-ZĦĊĠŻ][^\W\d_]+)\b\.?"),
}
_digits = re.compile(r"\d+")
#: What any number of the kinds looked for has in it.
_numeral = re.compile(r"\d[\d .\-]{3,}\d|\d{5}|\d{3,4}[- ]?\(?[A-Z]")
#: Blanks that ``back`` can have between the word for the street and the number, by its form.
_MOST_BLANKS = 4
_flat = re.compile(r"(?<![\w/-])(?:flat|fl\.?|apt\.?|appartament) ?\Z", re.I)
_name_part = re.compile(r"[^\W\d_]+")
#: What may stand between the words of a street's name and its number.
_between = re.compile(r"(?:,? |['’-]|\.|\. |° ?)\Z")


def addresses(text: str) -> Iterator[tuple[str, re.Match]]:
    """Candidates (shape, match) around each number of up to four digits."""
    for m in _digits.finditer(text):
        i = m.start()
        if m.end() - i > 4 or (i and (text[i - 1] in "/-_" or text[i - 1].isalnum())):
            continue
        flat = _flat.search(text, max(0, i - 13), i)  # its longest word has eleven letters
        at = i - len(flat.group()) if flat else i
        for shape in ("front", "title"):
            if found := ADDRESS[shape].match(text, at if shape == "front" else i):
                yield shape, found
        low = i
        for _ in range(_MOST_BLANKS + 1):
            low = text.rfind(" ", 0, low)
            if low < 0:
                break
        end = i
        for p in reversed(list(_name_part.finditer(text, low + 1, i))):
            if not (p.end() == end or _between.match(text[p.end() : end])):
                break
            end = p.start()
            if (found := ADDRESS["back"].match(text, end)) and found.end() > i:
                yield "back", found


_token = re.compile(r"[^\W\d_]+")
_words = re.compile(r"[^\W_]+")
_sentence = re.compile(r"[.!?…]+[\"')\]]*\s+(?=[\"'(\[+]*[^\W_])")
_TAIL = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + ".…\"'\\&#"
_digit = re.compile(r"\d")
_suspect = re.compile("[^\x00-\x7fħġċżĦĠĊŻàèìòùÀÈÌÒÙéÉ…]")


def _repairs() -> tuple[re.Pattern, dict[str, str]]:
    table = {}
    for way, letters in transformations().items():
        if way[0] == "utf-8":
            table |= {g: c for c, g in letters.items() if c.isalpha() and len(g) > 1}
    return re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))), table


_garbled, _letters = _repairs()
_segments = re.compile(r"\s+|\S+")


def readable(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The text as it reads, and places (readable, original) at which its segments begin if any differs."""
    if not _suspect.search(text):
        return text, None
    out, places, at = [], [], 0
    for m in _segments.finditer(text):
        piece = canonical_text(_garbled.sub(lambda g: _letters[g.group()], m.group()))
        places.append((at, m.start()))
        out.append(piece)
        at += len(piece)
    places.append((at, len(text)))
    return "".join(out), places


def original_span(places: list[tuple[int, int]] | None, start: int, end: int) -> tuple[int, int]:
    """A span of the readable text in the original one, widened to whole segments where they differ in length."""
    if places is None:
        return start, end
    low = max(p for p in places if p[0] <= start)
    high = min(p for p in places if p[0] >= end)
    same = all(a[0] - b[0] == a[1] - b[1] for a, b in zip(places[1:], places) if b[0] >= low[0] and a[0] <= high[0])
    return (low[1] + start - low[0], low[1] + end - low[0]) if same else (low[1], high[1])


def lowered(text: str) -> str:
    """Small letters, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Contexts:
    """The words of a text and its sentences, found once."""

    def __init__(self, text: str) -> None:
        found = [(m.start(), m.end(), m.group()) for m in _words.finditer(lowered(text))]
        self.starts, self.ends, self.words = ([x[k] for x in found] for k in range(3))
        self.text = text

    @cached_property
    def breaks(self) -> list[int]:
        return [m.end() for m in _sentence.finditer(self.text)]

    def around(self, start: int, end: int) -> tuple[str, str, str, str]:
        """Two words and one to the left, one and two to the right, within the sentence, however far they are."""
        k = bisect_right(self.breaks, start)
        low, high = self.breaks[k - 1] if k else 0, next(iter(self.breaks[bisect_left(self.breaks, end) :][:1]), None)
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        left = [self.words[x] if x >= 0 and self.starts[x] >= low else "^" for x in (i - 2, i - 1)]
        right = [self.words[x] if x < len(self.words) and (high is None or self.starts[x] < high) else "$" for x in (j, j + 1)]
        return f"L2 {left[0]} {left[1]}", f"L1 {left[1]}", f"R1 {right[0]}", f"R2 {right[0]} {right[1]}"


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", s))


def _pairs(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, first, second, seed) of neighbouring words of which at least one is listed."""
    tokens = [(m.start(), m.end(), m.group()) for m in _token.finditer(lowered(text))]
    for i in range(len(tokens) - 1):
        j = i + 1
        gap = text[tokens[i][1] : tokens[j][0]]
        if gap == " " and tokens[j][1] - tokens[j][0] == 1 and j + 1 < len(tokens) and text[tokens[j][1] : tokens[j + 1][0]] == ". ":
            j, gap = j + 1, " "
        if gap not in (" ", ", ", "  "):
            continue
        a, b = names.get(tokens[i][2]), names.get(tokens[j][2])
        if (a or b) and tokens[i][1] - tokens[i][0] >= 2 and tokens[j][1] - tokens[j][0] >= 2:
            end = tokens[j][1]
            if j + 1 < len(tokens) and text[end : tokens[j + 1][0]] == "-" and tokens[j + 1][0] - end == 1:
                end = tokens[j + 1][1]
            yield tokens[i][0], end, tokens[i][2], tokens[j][2], bool(a and b and a != b)


def candidates(text: str, names: dict[str, str]) -> list[tuple]:
    """(kind, start, end, key, other, shape, seed, at_end, L2, L1, R1, R2) of a readable text."""
    out, taken = [], []
    closed = len(text.rstrip(_TAIL))
    around = None

    def add(kind: str, start: int, end: int, key: str, other: str, shape: str, seed: str | None) -> None:
        nonlocal around
        around = around or Contexts(text)
        at_end = end >= closed and (not text[end:].strip().startswith((".", "!", "?")) or ".." in text[end:])
        out.append((kind, start, end, key, other, shape, seed, at_end, *around.around(start, end)))

    low = lowered(text)
    if "@" in text or ((" at" in low or "(at" in low or "[at" in low or "{at" in low or "chiocciola" in low or "\nat" in low or "\tat" in low) and _at_word.search(text)):
        for m in EMAIL.finditer(text):
            domain = _domain.search(m.group())
            taken.append(m.span())
            sign = re.sub(r"[^\W\d_]+(?=\W*$)", "", _first_at.search(m.group()).group())
            add("email", *m.span(), re.sub(r"\s", "", re.sub(_DOT, ".", domain.group(1).lower())) if domain else "", "", f"email{sign}", "email" if _plain_mail.fullmatch(m.group()) else None)
    if _digit.search(text):
        for shape, m in addresses(text):
            kind = m["t"].lower()
            seed = "address" if kind in SEED_TYPES else None
            if seed:
                taken.append(m.span())
            add("address", *m.span(), kind, m["s"].strip().lower(), shape, seed)
        for m in NUMBER.finditer(text) if _numeral.search(text) else ():
            if not any(a < m.end() and m.start() < b for a, b in taken):
                s = m.group()
                add("number", *m.span(), "", "", _shape(s), "phone" if _phone_seed.match(s) else "id_number" if _id_seed.match(s) else None)
    if not names.keys().isdisjoint(_token.findall(low)):
        for start, end, first, second, seed in _pairs(text, names):
            if not any(a < end and start < b for a, b in taken):
                add("name", start, end, first, second, "", "name" if seed else None)
    return out


_KEY = ["table_name", "field_name", "row_id"]
_COLUMNS = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.string()), ("other", pa.string()), ("shape", pa.string()), ("seed", pa.string()), ("at_end", pa.bool_()), ("l2", pa.string()), ("l1", pa.string()), ("r1", pa.string()), ("r2", pa.string())]
_DDL = "table_name string, field_name string, row_id bigint, kind string, start int, end int, key string, other string, shape string, seed string, at_end boolean, l2 string, l1 string, r1 string, r2 string"


def _each(judge):
    """Rows (table_name, field_name, row_id, text) -> a row for each item that ``judge`` finds in the readable text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judging = judge()
        for batch in batches:
            rows, items = [], []
            for i, text in enumerate(strings(batch.column(3))):
                if text:
                    for item in judging(readable(text)[0]):
                        rows.append(i)
                        items.append(item)
            if items:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in range(3)), *(pa.array(c, t) for c, (_, t) in zip(zip(*items), _COLUMNS))], names=[*_KEY, *(n for n, _ in _COLUMNS)])

    return run


def extract(values: DataFrame, names: dict[str, str]) -> DataFrame:
    """All candidates of values(table_name, field_name, row_id, text)."""
    return values.mapInArrow(_each(lambda: lambda text: candidates(text, names)), _DDL)


_name_after = re.compile(r"[\W_]{0,3}?(?P<a>[^\W\d_]{2,})(?P<gap>, | (?:[^\W\d_]\. )?)(?P<b>[^\W\d_]{2,})(?:-[^\W\d_]{3,})?(?![\w@+-]|\.\w)")


def _in_patterns(lefts: frozenset[str] | None):
    """Name-like pairs after the given left contexts (all if None), and a row without one where nothing name-like follows."""

    lasts = None if lefts is None else frozenset(left.rpartition(" ")[2] for left in lefts)

    def judge(text: str) -> list[tuple]:
        out: list[tuple] = []
        if lasts is not None and lasts.isdisjoint(_words.findall(lowered(text))):
            return out
        around = Contexts(text)
        closed = len(text.rstrip(_TAIL))
        for i, word in enumerate(around.words[:-1]):
            if lasts is not None and word not in lasts:
                continue
            at = around.ends[i]
            if lefts is not None and f"L2 {around.words[i - 1] if i else '^'} {word}" not in lefts and f"L2 ^ {word}" not in lefts:
                continue
            if not text[at : at + 1] or around.starts[i + 1] - at > 2:
                continue
            n = _name_after.match(text, around.starts[i + 1])
            start, end = (n.start("a"), n.end()) if n else (around.starts[i + 1], around.starts[i + 1])
            context = around.around(start, end)
            if lefts is not None and context[0] not in lefts:
                continue
            if n:
                at_end = end >= closed and not re.match(r"[.!?](?!\.)", text[end:])
                out.append(("name", start, end, n["a"].lower(), n["b"].lower(), n["gap"].strip(), None, at_end, *context))
            else:
                out.append(("none", start, start, "", "", "", None, False, *context))
        return out

    return lambda: judge


KINDS = {"email": ("email",), "number": ("phone", "id_number"), "address": ("address",), "name": ("name",)}
_COMBO = ("kind", "l2", "l1", "r1", "r2", "shape", "key", "seed")
#: What stands at the edge of a text alone is no pattern.
_EDGES = ("L2 ^ ^", "L1 ^", "R1 $", "R2 $ $")


def score(items: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of the graph of items(id, kind, l2, l1, r1, r2, shape, key, seed, n) and their patterns after some rounds.

    Returns the items with ``c_<kind>`` for every kind of personal data, and the patterns (p, all, s_<kind>). Patterns are
    those of their class of candidates. Contexts of great frequency are aggregated before they are shuffled.
    """
    every = [k for kinds in KINDS.values() for k in kinds]
    seeds = {k: F.when(F.col("seed") == k, 1.0).otherwise(0.0) for k in every}
    current = items.withColumns({f"c_{k}": c for k, c in seeds.items()})
    node = lambda at, c, wanted: F.when(wanted, F.struct(F.lit(at).alias("at"), F.concat_ws(" ", "kind", c).alias("p")))
    nodes = [node(i, F.col(c), ~F.col(c).isin(*_EDGES)) for i, c in enumerate(("l2", "r2", "l1", "r1"))]
    nodes += [node(4, F.concat(F.lit("S "), "shape"), F.col("shape") != ""), node(5, F.concat(F.lit("K "), "key"), F.col("key") != "")]
    spread = F.explode(F.filter(F.array(*nodes), lambda x: x.isNotNull())).alias("node")
    scored = None
    for _ in range(rounds):
        seen = current.select(spread, "n", *[f"c_{k}" for k in every]).select("node.p", "n", *[f"c_{k}" for k in every])
        scored = seen.groupBy("p").agg(F.sum("n").alias("all"), *[(F.sum(F.col("n") * F.col(f"c_{k}")) / (F.sum("n") + 1)).alias(f"s_{k}") for k in every])
        edges = items.select("id", spread).select("id", "node.at", "node.p").join(scored, "p").where("all >= 3")
        # What an item is named by counts first, then two words of context, then one, and the shape only where none is known.
        groups = (("key", (5,)), ("two", (0, 1)), ("one", (2, 3)), ("shape", (4,)))
        best = edges.groupBy("id").agg(*[F.avg(F.when(F.col("at").isin(*at), F.col(f"s_{k}"))).alias(f"{x}_{k}") for k in every for x, at in groups])
        current = items.join(best, "id", "left")
        for kind, kinds in KINDS.items():
            for k in kinds:
                learned = F.coalesce(F.nullif(f"key_{k}", F.lit(0.0)), f"two_{k}", f"one_{k}", f"shape_{k}", F.lit(0.0))
                current = current.withColumn(f"c_{k}", F.when(F.col("kind") != kind, 0.0).when(F.col("seed") == k, 1.0).when(F.col("seed").isNotNull(), 0.0).otherwise(learned))
        current = current.select(*items.columns, *[f"c_{k}" for k in every])
    return current, scored


def _within_reach(combos: DataFrame) -> DataFrame:
    """Candidates that the graph can reach from seeds: of street addresses, the kinds that stand in two words of context of a seed at least once."""
    streets = F.col("kind") == "address"
    sides = F.explode(F.filter(F.array("l2", "r2"), lambda c: ~c.isin(*_EDGES))).alias("context")
    near = combos.where(streets & F.col("seed").isNotNull()).select(sides).distinct()
    reached = combos.where(streets).select("key", sides).join(near, "context", "left_semi").select("key").distinct()
    return combos.where(~streets).unionByName(combos.where(streets).join(reached, "key", "left_semi").select(combos.columns))


def _same(left: str, right: str, columns: tuple[str, ...]):
    return F.expr(" and ".join(f"{left}.{c} <=> {right}.{c}" for c in columns))


def shaped(found: DataFrame) -> DataFrame:
    """E-mail addresses, numbers and street addresses: candidates that the graph accepts, and at the end of an open text those whose parts it knows."""
    rows = found.where("kind <> 'name'").withColumn("seed", F.when(~F.col("at_end"), F.col("seed")))
    combos = cut(_within_reach(rows.where("not at_end").groupBy(*_COMBO).agg(F.count("*").alias("n"))).withColumn("id", F.monotonically_increasing_id()))
    scored, _ = score(combos)
    own = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"c_{k}")).alias("c"), F.lit(i).alias("i"), F.lit(k).alias("decided"), (F.col(f"c_{k}") >= at).alias("good")) for i, (k, at) in enumerate(ACCEPT.items())]), lambda x: x["good"]))
    best = cut(scored.withColumn("own", own).where(F.size("own") > 0).select(*_COMBO, "n", F.get("own", F.lit(0))["decided"].alias("decided")))
    columns = [*_KEY, "start", "end", "kind", "seeded"]
    whole = rows.where("not at_end").alias("r").join(best.alias("b"), _same("r", "b", _COMBO)).select(*[f"r.{c}" for c in (*_KEY, "start", "end")], F.col("decided").alias("kind"), F.col("r.seed").isNotNull().alias("seeded"))
    ends = rows.where("at_end")
    # At the end of an open text: a number by shape and left context, an e-mail address by its domain, a street by its kind and, where its name ends the text, by its name.
    shapes = best.where("kind = 'number'").groupBy("shape", "decided").agg(F.sum("n").alias("n")).where("n >= 2").select("shape", "decided")
    lefts = best.where("kind = 'number'").select("l2", "decided").distinct()
    numbers = ends.where("kind = 'number'").join(shapes, "shape").join(lefts, ["l2", "decided"])
    domains = best.where("kind = 'email'").groupBy("key", "decided").agg(F.sum("n").alias("n")).where("n >= 2").select("key", "decided")
    mails = ends.where("kind = 'email'").join(domains, "key")
    types = best.where("kind = 'address'").groupBy("key", "decided").agg(F.sum("n").alias("n")).where("n >= 2").select("key", "decided")
    streets = rows.where("kind = 'address' and not at_end").join(types, "key").groupBy("other").agg(F.count("*").alias("n")).where("n >= 2").select("other")
    houses = ends.where("kind = 'address'").join(types, "key")
    roads = houses.where("shape <> 'back'").join(streets, "other", "left_semi").unionByName(houses.where("shape = 'back'"))
    out = whole
    for part in (numbers, mails, roads):
        out = out.unionByName(part.select(*_KEY, "start", "end", F.col("decided").alias("kind"), F.lit(False).alias("seeded")).dropDuplicates([*_KEY, "start", "end"]))
    return out.select(*columns)


def _roles(pairs: DataFrame) -> DataFrame:
    """(w, role): the words of accepted pairs with the role that their place gives them; after a comma the surname comes first."""
    comma = F.col("gap") == ","
    first, second = F.when(comma, F.col("other")).otherwise(F.col("key")), F.when(comma, F.col("key")).otherwise(F.col("other"))
    both = F.array(F.struct(first.alias("w"), F.lit("NAME").alias("role")), F.struct(second.alias("w"), F.lit("SNAME").alias("role")))
    return pairs.select(F.explode(both).alias("x")).select("x.*").distinct()


def person_names(values: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """Given name and surname together: listed pairs, pairs in good contexts, and pairs with a discovered half, in rounds.

    names(lw, lrole) is the list. Contexts of the pairs known so far are looked for in the texts until no context is new.
    """
    listed = found.where("kind = 'name'")
    seeds = listed.where("seed = 'name'").withColumn("gap", F.lit(""))
    columns = [*_KEY, "start", "end", "key", "other", "gap", "l2", "r1", "r2"]
    known = seeds.select(*columns)
    ends_of = seeds.where("at_end").select(*_KEY, "start")
    halves = listed.where("seed is null")
    done: DataFrame | None = None
    near: DataFrame | None = None
    for _ in range(ROUNDS):
        contexts = known.where(~F.col("l2").isin(*_EDGES)).groupBy("l2").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_SEEDS).select("l2")
        if done is not None:
            contexts = contexts.join(done, "l2", "left_anti")
        contexts = cut(contexts)
        few = contexts.limit(SENT_ROWS + 1).collect()
        if not few:
            break
        if len(few) <= SENT_ROWS:
            rows = values.mapInArrow(_each(_in_patterns(frozenset(r["l2"] for r in few))), _DDL)
        else:
            rows = values.mapInArrow(_each(_in_patterns(None)), _DDL).join(contexts, "l2", "left_semi")
        rows = cut(rows)
        near = rows if near is None else near.unionByName(rows)
        done = contexts if done is None else done.unionByName(contexts)
        marks = known.select(*_KEY, "start", F.lit(1).alias("is_known")).distinct()
        marked = near.join(marks, [*_KEY, "start"], "left")
        worth = marked.groupBy("l2").agg(F.avg(F.coalesce("is_known", F.lit(0))).alias("worth")).where(F.col("worth") >= WORTH).select("l2")
        rights = known.join(ends_of, [*_KEY, "start"], "left_anti").select(F.explode(F.array("r1", "r2")).alias("right")).groupBy("right").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_SEEDS).select("right")
        fits = near.where("kind = 'name'").join(worth, "l2", "left_semi").withColumn("right", F.explode(F.array("r1", "r2"))).join(rights, "right", "left_semi").drop("right")
        fits = fits.where("not at_end").withColumn("gap", F.col("shape")).select(*columns).dropDuplicates([*_KEY, "start"])
        words = _roles(fits)
        # A half that the list lacks must have been discovered in the other role.
        a = halves.join(names, F.col("key") == F.col("lw")).join(words, (F.col("other") == F.col("w")) & (F.col("role") != F.col("lrole")))
        b = halves.join(names, F.col("other") == F.col("lw")).join(words, (F.col("key") == F.col("w")) & (F.col("role") != F.col("lrole")))
        completed = [x.withColumn("gap", F.lit("")).select(*columns) for x in (a, b)]
        known = cut(seeds.select(*columns).unionByName(fits).unionByName(completed[0]).unionByName(completed[1]).dropDuplicates([*_KEY, "start", "end"]))
    out = known.select(*_KEY, "start", "end")
    if near is not None:
        # At the end of an open text both words of a discovered pair must be known whole.
        words = cut(_roles(known.join(ends_of, [*_KEY, "start"], "left_anti")).select("w").distinct())
        open_ends = near.where("kind = 'name' and at_end").join(words.withColumnRenamed("w", "key"), "key", "left_semi").join(words.withColumnRenamed("w", "other"), "other", "left_semi")
        out = out.unionByName(open_ends.select(*_KEY, "start", "end"))
    is_seed = seeds.select(*_KEY, "start", "end", F.lit(True).alias("is_seed")).distinct()
    out = out.distinct().join(is_seed, [*_KEY, "start", "end"], "left")
    return out.select(*_KEY, "start", "end", F.lit("name").alias("kind"), F.coalesce("is_seed", F.lit(False)).alias("seeded"))


def items(values: DataFrame, name_list: DataFrame, surface: str = "surface", payload: str = "payload") -> DataFrame:
    """(table_name, field_name, row_id, start, end, kind, seeded) of all items; places are those of the readable text.

    The name list is sent to the workers up to ``SENT_ROWS`` rows; of a longer one only the names that stand in the texts
    can matter, and those are found by a join.
    """
    listed = name_list.where(F.col(surface).isNotNull()).groupBy(F.lower(surface).alias("lw")).agg(F.max(payload).alias("lrole"))
    texts = values.where(F.col("text").isNotNull()).select(*_KEY, "text")
    few = listed.limit(SENT_ROWS + 1).collect()
    if len(few) > SENT_ROWS:
        spelled = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("lw")).groupBy("lw").agg(F.count("*").alias("k"))
        listed = cut(listed.join(spelled, "lw", "left_semi"))
        few = listed.collect()  # names of the list that occur
    names = {r["lw"]: r["lrole"] for r in few}
    found = cut(extract(texts, names))
    return shaped(found).unionByName(person_names(texts, found, listed))


def evidence(found: DataFrame) -> DataFrame:
    """(kind, seeded, discovered): how many items of each kind were seeds, and how many the patterns found."""
    return found.groupBy("kind").agg(F.count_if("seeded").alias("seeded"), F.count_if(~F.col("seeded")).alias("discovered"))


def _settled(spans: list[dict]) -> list[dict]:
    """Of street addresses that overlap one stays: a seed, else the shortest."""
    kept: list[dict] = []
    for s in sorted((s for s in spans if s["kind"] == "address"), key=lambda s: (not s["seeded"], s["end"] - s["start"], s["start"])):
        if not any(s["start"] < k["end"] and k["start"] < s["end"] for k in kept):
            kept.append(s)
    return kept + [s for s in spans if s["kind"] != "address"]


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for text, spans in zip(strings(batch.column(3)), batch.column(4).to_pylist()):
            _, places = readable(text)
            out, at = [], 0
            for s in sorted(_settled(spans), key=lambda s: (s["start"], -s["end"])):
                start, end = original_span(places, s["start"], s["end"])
                if start >= at:
                    out += [text[at:start], PLACEHOLDER[s["kind"]]]
                at = max(at, end)
            done.append("".join(out) + text[at:])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(done, pa.string())], names=[*_KEY, "redacted"])


def redacted(values: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, field_name, row_id, redacted) of the values that hold an item."""
    spans = found.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end", "kind", "seeded")).alias("spans"))
    rows = values.select(*_KEY, "text").join(spans, _KEY)
    return rows.mapInArrow(_replace, "table_name string, field_name string, row_id bigint, redacted string")
