r"""Text cut off by field limits (problem 3).

A candidate is a value that doesn't end with a closing mark or that ends with an ellipsis; look-ups of a few words without
a mark are none. Every candidate is scored by the same kinds of evidence, and none is decided by a missing full stop alone:

* ``trie``: the corpus vocabulary as a trie, a table of all prefixes of known words, kept with whether a longer word goes
  through them; a final token that is no known word but such a prefix was cut within the word. A character reference or
  an escape that isn't finished counts like it;
* ``limit``: the limits of each source and field are the lengths at which its candidates gather (different texts only);
* ``context``: how often the last tokens end a sentence in the corpus, by counts of the last three, two and one of them
  (words after an article are one class, so that the counts say which position of a sentence it is), and signs that
  never end one;
* ``mark``: the corpus closes a sentence after these tokens, and the source closes its values, so that a mark is missing.

Counts cover the whole text of every log. Workers combine their own before the shuffle, and nothing is collected.

Defined results: null and blank values are whole; a look-up (at most ``LOOKUP_WORDS`` words, not for notes) is whole
without a closing mark; repeated rows are judged each by itself; a null client is a source of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import strings
from textloom.llm.encoding import READ, read_as
from textloom.session import cut

LOOKUP_WORDS = 4
#: Counts from which a context of three, two or one token is believed.
BELIEVE = (4, 6, 6)
ENDS = 0.5
#: Weights of the evidence; a value was cut if their sum is above 0. A missing mark (open) or an ellipsis (trails) speaks for nothing by itself.
WEIGHTS = {"trie": 4.0, "context": 3.0, "limit": 2.0, "likely": 1.0, "mark": 1.0, "trails": -2.5, "open": -0.5}
#: A word that stands less often than this share of the longer words through its node is no known word there.
RARE = 0.01


def _forms() -> list[str]:
    """The ellipsis and what it becomes when it is read in a wrong encoding once or twice, longest first."""
    forms = {"…"}
    for _ in range(2):
        forms |= {"".join(read_as(c, "utf-8", read) or c for c in form) for form in forms for read in READ}
    return sorted(forms, key=lambda f: (-len(f), f))


FORMS = _forms()
_CLOSERS = "\"'”’»)]"
_ELLIPSES = ("..", *FORMS)

_py_invisible = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_py_article = re.compile(r"(?<![^\W\d_])(?<!-)(?:il|l|i[cċdnrstxzż])-[^\W\d_][^\W\d_'\u0307]*|\d+")
_py_determiner = re.compile(r"(?<![^\W\d_])(the|another|an?|this|his|her|our|la|lo|un|una|gli) [^\W\d_]+")
_py_end = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)")
_py_drop = re.compile(r"[\",;:()\[\]]+")
_py_strip = "\"'([.,;:!?…)]"


def tokens(text: str) -> list[str]:
    """Tokens of a text; sentence ends are tokens of their own, words after an article are one class."""
    t = _py_determiner.sub(r"\1 <n>", _py_article.sub("<a>", text.lower()))
    return _py_drop.sub(" ", _py_end.sub(" </s> ", t)).split()


def seen(text: str) -> str:
    """The text without what can't be seen and without blanks at its end."""
    return (_py_invisible.sub("", text) if not text.isascii() else text).rstrip()


def ending(text: str) -> str:
    """How a seen text ends: "closed", "trails" or "open"."""
    core = text.rstrip(_CLOSERS)
    return "trails" if core.endswith(_ELLIPSES) else "closed" if core.endswith((".", "!", "?")) else "open"


def parts(text: str) -> tuple[str, bool]:
    """(the text without what may be broken off at its end, whether it ends with a closing mark)."""
    text = seen(text)
    closed = ending(text) == "closed"
    return text if closed else text.rpartition(" ")[0], closed


def body(text: str) -> str:
    """A text without the ellipsis at its end."""
    text = seen(text)
    if ending(text) != "trails":
        return text
    core = text.rstrip(_CLOSERS)
    if core.endswith(".."):
        return core.rstrip(".")
    return core[: -len(next(f for f in FORMS if core.endswith(f)))]


def contexts(t: list[str], i: int) -> tuple[str, str, str]:
    """The last one, two and three tokens up to i as keys."""
    return "1 " + t[i], f"2 {t[i - 1] if i else '<s>'} {t[i]}", f"3 {t[i - 2] if i > 1 else '<s>'} {t[i - 1] if i else '<s>'} {t[i]}"


_COUNTS = pa.schema([("key", pa.string()), ("n", pa.int64()), ("n_end", pa.int64())])
#: Keys that a worker holds before it hands its partial counts on.
_HELD = 400_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (key "w ...") and contexts; whole texts, combined before the shuffle."""
    every: Counter[str] = Counter()
    ends: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(every)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(every.values(), pa.int64()), pa.array([ends[k] for k in keys], pa.int64())], schema=_COUNTS)

    for batch in batches:
        words: list[str] = []
        for text in strings(batch.column(0)):
            if not text:
                continue
            inner, _ = parts(text)
            words += inner.split()
            t = tokens(body(text))
            every.update("1 " + x for x in t[:-1])
            every.update(f"2 {x} {y}" for x, y in zip(["<s>", *t], t[:-1]))
            every.update(f"3 {x} {y} {z}" for x, y, z in zip(["<s>", "<s>", *t], ["<s>", *t], t[:-1]))
            for i in range(len(t) - 1):
                if t[i + 1] == "</s>":
                    ends.update(contexts(t, i))
        for word, n in Counter(words).items():
            w = word.lower().strip(_py_strip)
            if w:
                every["w " + w] += n
        if len(every) > _HELD:
            yield flush()
            every.clear()
            ends.clear()
    if every:
        yield flush()


def counts(texts: DataFrame) -> DataFrame:
    """(key, n, n_end) of texts(text): how often a word or context stands, and how often a sentence ends there."""
    partial = texts.mapInArrow(_count, "key string, n bigint, n_end bigint")
    return partial.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


#: Prefixes up to this length are made of every word; longer ones only where a final token has their length.
_SHORT_NODE = 60


def trie(words: DataFrame, long_nodes: list[int] | None = None) -> DataFrame:
    """(node, known, inner): prefixes of words, whether each is a known word itself, and whether a longer one goes on.

    All prefixes of up to ``_SHORT_NODE`` characters, and those of the lengths ``long_nodes``; words have any length.
    """
    size = F.char_length("word")
    short = F.sequence(F.lit(1), F.least(size, F.lit(_SHORT_NODE)))
    longer = F.filter(F.array(*[F.lit(n) for n in long_nodes]), lambda n: n <= size) if long_nodes else F.expr("cast(array() as array<int>)")
    nodes = words.select("word", "n", F.explode(F.concat(short, longer)).alias("k"))
    nodes = nodes.select(F.substring("word", F.lit(1), F.col("k")).alias("node"), (F.col("k") == size).alias("whole"), "n")
    own, more = F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0))
    return nodes.groupBy("node").agg(((own > 0) & (own >= RARE * more)).alias("known"), (more > 0).alias("inner"))


_OPEN = pa.schema([("length", pa.int32()), ("many", pa.bool_()), ("trails", pa.bool_()), ("broken", pa.bool_()), ("dangling", pa.bool_()), ("sentence", pa.bool_()), ("token", pa.string()), ("k1", pa.string()), ("k2", pa.string()), ("k3", pa.string()), ("n_closed", pa.int64())])
_DDL = "length int, many boolean, trails boolean, broken boolean, dangling boolean, sentence boolean, token string, k1 string, k2 string, k3 string, n_closed bigint"
_many = re.compile(rf"\s*(?:\S+\s+){{{LOOKUP_WORDS}}}\S")
#: A character reference or an escape that isn't finished.
_broken = re.compile(r"(?:&#?\w{0,8}|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?)\Z")


def _end(text: str | None, notes: bool) -> tuple | bool | None:
    """What the end of a candidate looks like; True for a closed value of several words, None for all others."""
    text = seen(text or "")
    if not text:
        return None
    how = ending(text)
    many = bool(_many.match(text))
    if how == "closed":
        return True if many or notes else None
    if how == "open" and not (many or notes):
        return None
    before = body(text)
    t = tokens(before)
    last = (before.split() or [""])[-1].lower().strip(_py_strip)
    keys = contexts(t, len(t) - 1) if t else ("", "", "")
    # Notes are written by a program, which lets nothing trail off.
    return (many, how == "trails" and not notes, bool(_broken.search(before)), before.endswith((",", ";", ":", "-")) or before[-1:].isspace(), ending(before.rstrip()) == "closed", last, *keys)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(table_name, field_name, row_id, client, text) -> candidates, and how many values of each source are closed."""
    closed: Counter[tuple] = Counter()
    names = None
    for batch in batches:
        rows, found = [], []
        names, kinds = batch.schema.names[:-1], [f.type for f in batch.schema][:-1]
        tables, fields, clients = (batch.column(c).to_pylist() for c in ("table_name", "field_name", "client"))
        for i, text in enumerate(strings(batch.column(batch.num_columns - 1))):
            if (end := _end(text, fields[i] == "notes")) is True:
                closed[tables[i], fields[i], clients[i]] += 1
            elif end is not None:
                rows.append(i)
                found.append((len(text), *end, None))
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *(pa.array(c, f.type) for c, f in zip(zip(*found), _OPEN))], names=[*names, *_OPEN.names])
    if closed:
        n = len(closed)
        known = dict(zip(("table_name", "field_name", "client"), zip(*closed)))
        own = [pa.array(known[c], k) if c in known else pa.nulls(n, k) for c, k in zip(names, kinds)]
        yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, f.type) for f in list(_OPEN)[:-1]), pa.array(closed.values(), pa.int64())], names=[*names, *_OPEN.names])


def limits(candidates: DataFrame) -> DataFrame:
    """(client, field_name, length, at_limit): lengths at which a source's candidates gather, counting different endings."""
    by = candidates.where("many").groupBy("client", "field_name", "length").agg(F.count_distinct("k3", "token").alias("k"))
    all_of = by.groupBy("client", "field_name").agg(F.sum("k").alias("every"))
    joined = by.alias("b").join(all_of.alias("a"), F.expr("b.client <=> a.client and b.field_name = a.field_name"))
    return joined.where("k >= 5 and k >= 0.1 * every").select("b.client", "b.field_name", "b.length", F.lit(True).alias("at_limit"))


def judged(values: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates with ``is_cut`` and the ``evidence`` that weighs most; all other values are whole. corpus(text) gives the counts.

    values has table_name, field_name, row_id, client and text; its text is read once, in Arrow batches.
    """
    columns = ["table_name", "field_name", "row_id", "client"]
    rows = values.select(*columns, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    every = cut(rows.mapInArrow(_ends, f"{kinds}, {_DDL}"))
    candidates = every.where("n_closed is null").drop("n_closed")
    closing = every.groupBy("table_name", "field_name", "client").agg((F.coalesce(F.sum("n_closed"), F.lit(0)) / (F.count_if(F.col("n_closed").isNull() & ~F.col("trails")) + F.coalesce(F.sum("n_closed"), F.lit(0)))).alias("closes"))
    counted = cut(counts(corpus))
    words = counted.where("key like 'w %'").select(F.expr("substring(key, 3)").alias("word"), "n")
    size = F.char_length("token")
    long_nodes = sorted(r[0] for r in candidates.where(size > _SHORT_NODE).select(size).distinct().collect())  # lengths only
    known = candidates.join(trie(words, long_nodes).withColumnRenamed("node", "token"), "token", "left")
    for k in (1, 2, 3):
        needed = candidates.select(F.col(f"k{k}").alias("key")).distinct()
        met = counted.where(F.col("n") >= BELIEVE[3 - k]).join(needed, "key").select(F.col("key").alias(f"k{k}"), (F.col("n_end") / F.col("n")).alias(f"p{k}"))
        known = known.join(met, f"k{k}", "left")
    known = known.alias("v").join(limits(candidates).alias("b"), F.expr("v.client <=> b.client and v.field_name = b.field_name and v.length = b.length"), "left").select("v.*", "at_limit")
    known = known.alias("v").join(closing.alias("c"), F.expr("v.client <=> c.client and v.field_name = c.field_name and v.table_name = c.table_name"), "left").select("v.*", "closes")
    ends = F.coalesce("p3", "p2", "p1")
    within = F.col("broken") | (~F.coalesce("known", F.lit(False)) & F.coalesce("inner", F.lit(False)))
    # After a full sentence only a cut word speaks against a writer who lets the text trail off.
    plain = ~(F.col("trails") & F.col("sentence"))
    weights = {
        "trie": F.when(within, WEIGHTS["trie"]),
        "context": F.when(plain & (F.col("dangling") | (ends < ENDS)), WEIGHTS["context"]).when(plain & (ends < 0.9), WEIGHTS["likely"]),
        "limit": F.when(plain & F.col("at_limit"), WEIGHTS["limit"]),
        "mark": F.when(~F.col("trails") & (ends >= 0.9) & (F.col("closes") >= 0.5), WEIGHTS["mark"]),
    }
    known = known.withColumns({f"w_{n}": F.coalesce(w, F.lit(0.0)) for n, w in weights.items()})
    score = reduce(lambda a, b: a + b, (F.col(f"w_{n}") for n in weights)) + F.when(F.col("trails"), WEIGHTS["trails"]).otherwise(WEIGHTS["open"])
    most = F.greatest(*(F.col(f"w_{n}") for n in weights))
    evidence = reduce(lambda w, n: w.when(F.col(f"w_{n}") == most, n), list(weights)[1:], F.when(F.col("w_trie") == most, "trie"))
    return known.withColumn("is_cut", score > 0).select(*columns, "is_cut", F.when(score > 0, evidence).alias("evidence"))


def values(logs: DataFrame, choices: DataFrame) -> DataFrame:
    """The four fields with the client of each value; a choice takes the client of its log."""
    parts = [logs.select(F.lit("create_log").alias("table_name"), F.lit(f).alias("field_name"), "row_id", "client", F.col(f).alias("text")) for f in ("input", "notes", "final_output")]
    client = logs.where(F.col("log_id").isNotNull()).groupBy("log_id").agg(F.max("client").alias("client"))
    parts.append(choices.select("row_id", "log_id", F.col("final_output").alias("text")).join(client, "log_id", "left").select(F.lit("update_choice").alias("table_name"), F.lit("final_output").alias("field_name"), "row_id", "client", "text"))
    return reduce(DataFrame.unionByName, parts)


def corpus(logs: DataFrame) -> DataFrame:
    """The texts whose words and sentence ends are counted: all inputs, notes and corrected outputs."""
    return logs.select(F.explode(F.array("input", "notes", "final_output")).alias("text")).where(F.col("text").isNotNull())


EVIDENCE = ("trie", "context", "limit", "mark")


def rates(values: DataFrame, rows: DataFrame) -> DataFrame:
    """(client, table_name, field_name, n_values, n_cut, share_cut) for each source and field, and the cuts by evidence."""
    by = ["client", "table_name", "field_name"]
    none = F.lit(0).cast("bigint")
    every = values.where(F.col("text").isNotNull()).groupBy(*by).agg(F.count("*").alias("n_values"), none.alias("n_cut"), *[none.alias(f"by_{e}") for e in EVIDENCE])
    cuts = rows.where("is_cut").groupBy(*by).agg(none.alias("n_values"), F.count("*").alias("n_cut"), *[F.count_if(F.col("evidence") == e).alias(f"by_{e}") for e in EVIDENCE])
    out = every.unionByName(cuts).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_values", "n_cut", *(f"by_{e}" for e in EVIDENCE))])
    return out.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_values"), 6))
