"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are e-mail addresses, IP addresses, card and phone numbers that fixed
expressions find, whatever their letters.  The words around an instance are its
lexical patterns (the two words before it; the word before and the word after),
and patterns and instances make a bipartite graph that is scored in rounds:

1. A pattern is accepted by the share of its distinct instances that are known
   to be of one kind (LEAST_SHARE, with LEAST_SUPPORT of them at least).
2. A word that stands where an accepted pattern wants an instance is learnt if
   accepted patterns surround enough of all its places (LEAST_INSIDE) and it does
   not stand there far more often than a known instance (MOST_TIMES), so common
   words are not learnt: neither *the* nor *us* in "contact us".
3. Learnt words are known from then on, wherever they stand, and bring further
   patterns.

This goes on until no pattern is newly accepted.  The places of learnt words in
accepted patterns become ``context`` spans.

The graph of all words is never written.  A round reads the texts for the places
of patterns that can still reach the share and for the words that can still be
learnt; counts in a part of the texts are lower bounds that leave out the others
before.  Words and patterns are compared by their 64-bit hashes.

Positions come from cutting the text at the matches: the lengths of the pieces
and matches before a match give its start in code points.  All folds over the
matches of a text run in chunks, so that their cost stays in proportion to it.

Expressions carry possessive repeats and look-behinds so that they stay linear
in the text; these find the same leftmost, non-overlapping matches as the plain
forms.

Defined results: a null text is the empty text, without spans; equal starts go
in the order of KINDS; repeated rows have the same spans; words without a letter
or digit are no candidates; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, few, table, text_of, written

KINDS = ("email", "ip", "card", "phone", "context")
BASE = 4
#: A pattern needs this many distinct known instances of one kind, and this share of all its distinct instances.
LEAST_SUPPORT, LEAST_SHARE = 5, 0.8
#: A word is learnt if this share of all its places is in accepted patterns, and these are at most so many times the mean of a known instance.
LEAST_INSIDE, MOST_TIMES = 1 / 3, 10
#: Rounds after which the iteration fails instead of giving a part of the result.
MOST_ROUNDS = 100
#: One text of so many is read for the lower bounds.
PART = 32
#: Matches of a text that one step of a fold takes.
CHUNK = 256

_EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"\p{L}\p{M}\p{N}_"
#: What surrounds the core of a word, and the punctuation that patterns leave out.
_EDGES = rf"(?=[^{_WORD}\s])(?:(?<!\S)[^{_WORD}+(\s]++(?=[{_WORD}+(])|(?<=[{_WORD})])[^{_WORD})\s]++(?!\S))"
_PUNCTUATION = r"(?=[^\w\s#])(?:(?<!\S)[^\w\s#]++(?=[\w#])|(?<=[\w#])[^\w\s#]++(?!\S))"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        digit = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(k % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(values: Column) -> Column:
    """A list that is not empty, in lists of CHUNK elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))


def _sums(values: Column) -> Column:
    """Running sums of a list of numbers that is not empty."""

    def last(a: Column) -> Column:
        return F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))

    def fold(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda a, n: F.array_append(a, last(a) + n))

    def joined(parts: Column) -> Column:
        before = fold(F.concat(F.array(F.lit(0)), F.transform(F.slice(parts, 1, F.size(parts) - 1), last)))
        return F.flatten(F.zip_with(parts, before, lambda part, n: F.transform(part, lambda x: x + n)))

    return _let(F.transform(_chunks(values), fold), joined)


def _cut(df: DataFrame, name: str, expression: str, guard: Column) -> DataFrame:
    """Add ``m_name`` (matches), ``p_name`` (pieces between) and ``s_name`` (starts of the matches)."""
    m, p, s = (f"{c}_{name}" for c in "mps")
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(guard, F.regexp_extract_all("t", F.lit(expression), F.lit(0))).otherwise(none))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split("t", expression, -1)).otherwise(none))
    # what stands before each match: a piece, and the match before that
    lengths = F.zip_with(F.slice(p, 1, F.size(m)), F.concat(F.array(F.lit(0)), F.transform(F.slice(m, 1, F.size(m) - 1), F.length)), lambda a, b: F.coalesce(F.length(a), F.lit(0)) + b)
    return df.withColumn(s, F.when(F.size(m) > 0, _sums(lengths)).otherwise(F.array().cast("array<int>")))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _span(number: int, kind: str):
    return lambda m, s: F.struct(s.alias("start"), F.lit(number).alias("kind"), (s + F.length(m)).alias("end"), _valid(kind, m).alias("good"))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def _core(word: Column) -> Column:
    return F.regexp_replace(word, _EDGES, "")


def _near(text: Column) -> Column:
    """Words of a text as patterns have them: lower case, numbers as ``#``, without punctuation at their ends."""
    return _split(F.lower(F.regexp_replace(F.regexp_replace(text, "[0-9]+", "#"), _PUNCTUATION, "")))


def _before(one: Column, two: Column) -> Column:
    return F.when(one.isNotNull() & two.isNotNull(), F.xxhash64(F.lit("l"), one, two))


def _around(one: Column, two: Column) -> Column:
    return F.when(one.isNotNull() & two.isNotNull(), F.xxhash64(F.lit("b"), one, two))


def _contexts(kind: str, number: int) -> Column:
    """``kind, instance, first, before, around`` of each valid match: hashes of the match, of the core of its first word, and of its patterns."""

    def all_of(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            left, right = F.get(x["p"], i), F.get(x["p"], i + 1)
            # what touches the match belongs to its word
            head, tail = F.regexp_extract(left, r"((?<!\S)\S*+)\z", 1), F.regexp_extract(right, r"^(\S*+)", 1)
            words, after = F.get(x["near"], i), F.get(x["near"], i + 1)
            n = F.size(words) - (head != "").cast("int")
            last, next_ = F.get(words, n - 1), F.get(after, (tail != "").cast("int"))
            token = F.concat(head, F.substring_index(m, " ", 1), F.when(F.contains(m, F.lit(" ")), "").otherwise(tail))
            lexical = last.rlike(r"\p{L}")
            return F.struct(
                F.lit(number).alias("kind"), F.xxhash64(m).alias("instance"), F.xxhash64(_core(token)).alias("first"),
                F.when(lexical, _before(F.get(words, n - 2), last)).alias("before"), F.when(lexical, _around(last, next_)).alias("around"), _valid(kind, m).alias("good"),
            )

        return F.filter(F.transform(x["m"], one), lambda s: s["good"])

    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    return F.when(F.size(m) > 0, _let(F.struct(m.alias("m"), p.alias("p"), F.transform(p, _near).alias("near")), all_of))


def with_spans(docs: DataFrame, seeds: bool = False) -> DataFrame:
    """Add ``base`` spans of column ``t``, and with ``seeds`` the matches with their patterns."""
    columns = docs.columns
    has_digit = F.col("t").rlike("[0-9]")
    guards = {"email": F.instr("t", "@") > 0, "ip": has_digit, "card": has_digit, "phone": F.instr("t", "+") > 0}
    for kind, expression in _EXPRESSIONS.items():
        docs = _cut(docs, kind, expression, guards[kind])
    found = []
    for number, kind in enumerate(KINDS[:BASE]):
        good = F.filter(F.zip_with(f"m_{kind}", f"s_{kind}", _span(number, kind)), lambda x: x["good"])
        found.append(F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    base = F.array_sort(F.concat(*found)).cast(_SPAN).alias("base")
    if not seeds:
        return docs.select(*columns, base)
    none = F.array().cast("array<struct<kind:int,instance:bigint,first:bigint,before:bigint,around:bigint,good:boolean>>")
    return docs.select(*columns, base, F.concat(*(F.coalesce(_contexts(kind, n), none) for n, kind in enumerate(KINDS[:BASE]))).alias("seeds"))


def _words(texts: DataFrame) -> DataFrame:
    """``key, i, word, before, around`` of every word of every text: hashes of its core and of its patterns."""
    near = _near(F.col("t"))

    def nodes(x: Column) -> Column:
        def one(core: Column, i: Column) -> Column:
            last = F.get(x["near"], i - 1)
            return F.struct(i.alias("i"), F.when(core.rlike(r"[\p{L}\p{N}]"), F.xxhash64(core)).alias("word"), _before(F.get(x["near"], i - 2), last).alias("before"), _around(last, F.get(x["near"], i + 1)).alias("around"))

        return F.transform(x["cores"], one)

    every = _let(F.struct(_split(_core(F.col("t"))).alias("cores"), near.alias("near")), nodes)
    return texts.select("key", F.inline(every)).where("word is not null")


def _slots(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``key, i, word, pattern`` of the words where one of ``patterns`` (written, distinct) wants an instance."""
    words = _words(texts).select("key", "i", "word", F.explode(F.array("before", "around")).alias("pattern")).where("pattern is not null")
    return words.join(few(patterns), "pattern", "left_semi")


def _best(beside: DataFrame) -> DataFrame:
    """``pattern, n, kind, named``: the kind of most known instances, their number, and that of known ones of any kind."""
    counts = beside.groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("n"))
    return counts.groupBy("pattern").agg(F.max(F.struct("n", "kind")).alias("best"), F.sum("n").alias("named")).select("pattern", "best.n", "best.kind", "named")


def _able(best: DataFrame, strange: DataFrame, share: float) -> DataFrame:
    """Rows of ``best`` that reach the share if ``strange (pattern, strange)`` are all unknown instances."""
    every = F.col("named") + F.coalesce("strange", F.lit(0))
    return best.join(strange, "pattern", "left").where(F.col("n") >= share * every).select(*best.columns)


def _strange(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Number of distinct unknown words of each pattern."""
    return rows.select("pattern", "word").distinct().join(known, "word", "left_anti").groupBy("pattern").agg(F.count("*").alias("strange"))


def discover(texts: DataFrame, seeds: DataFrame, support: int = LEAST_SUPPORT, share: float = LEAST_SHARE, inside: float = LEAST_INSIDE) -> DataFrame:
    """``key, i`` of words that only their surroundings give away.

    ``texts``: ``key, t``; ``seeds``: ``kind, instance, first, before, around`` of the matches of the expressions.
    """
    known = written(seeds.select(F.col("first").alias("word")).distinct(), "known")  # words that a known instance begins with
    pairs = seeds.select("instance", "kind", F.explode(F.array("before", "around")).alias("pattern")).where("pattern is not null")
    beside = written(pairs.distinct(), "beside")
    part = texts.where(F.pmod("key.a", F.lit(PART)) == 0)
    mean = seeds.agg(F.try_divide(F.count("*"), F.count_distinct("instance"))).first()[0] or 1.0
    asked = accepted = rows = found = None  # patterns whose words have been read, accepted ones, all places of the former, of learnt words
    for _ in range(MOST_ROUNDS):
        best = written(_best(beside).where(F.col("n") >= support).where(F.col("n") >= share * F.col("named")), "best")
        open_ = written(best if asked is None else best.join(few(asked), "pattern", "left_anti"), "open")
        if not open_.isEmpty():
            able = written(_able(open_, _strange(_slots(part, open_.select("pattern")), known), share).select("pattern"), "able")
            if not able.isEmpty():
                more = written(_slots(texts, able), "slots")
                rows = more if rows is None else rows.union(more)
                asked = able if asked is None else asked.union(able)
        if rows is None:
            break
        fresh = _able(best.join(few(asked), "pattern", "left_semi"), _strange(rows, known), share).select("pattern", "kind")
        fresh = written(fresh if accepted is None else fresh.join(few(accepted), "pattern", "left_anti"), "patterns")
        if fresh.isEmpty():
            break
        accepted = fresh if accepted is None else accepted.union(fresh)
        held = rows.join(few(accepted), "pattern").join(known, "word", "left_anti")
        held = held.groupBy("word").agg(F.count_distinct("key", "i").alias("inside"), F.min("kind").alias("kind"))
        held = written(held.where(F.col("inside") <= MOST_TIMES * mean), "candidates")
        seen = _words(part).join(few(held.select("word")), "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
        rare = written(held.join(seen, "word", "left").where(F.col("inside") >= inside * F.coalesce("seen", F.lit(0))).select(*held.columns), "rare")
        if rare.isEmpty():
            break
        places = written(_words(texts).join(few(rare.select("word")), "word", "left_semi"), "places")
        all_ = places.groupBy("word").agg(F.count("*").alias("seen"))
        learnt = written(rare.join(all_, "word").where(F.col("inside") >= inside * F.col("seen")).select("word", "kind"), "learnt")
        if learnt.isEmpty():
            break
        of_learnt = written(places.join(few(learnt), "word").select("word", "kind", F.explode(F.array("before", "around")).alias("pattern")).where("pattern is not null").distinct(), "beside")
        beside = beside.union(of_learnt.select(F.col("word").alias("instance"), "kind", "pattern"))
        known = written(known.union(learnt.select("word")).distinct(), "known")
        found = learnt.select("word") if found is None else found.union(learnt.select("word"))
        dropped(held, rare, places, best, open_)
    else:
        raise RuntimeError(f"patterns were still being accepted after {MOST_ROUNDS} rounds")
    if found is None:
        return texts.select("key", F.lit(0).alias("i")).limit(0)
    return rows.join(few(accepted), "pattern", "left_semi").join(found, "word", "left_semi").select("key", "i").distinct()


def _placed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``key, start, end`` of the cores of the found words: lengths of what comes before, as running sums."""
    held = texts.join(few(written(found.select("key").distinct(), "held")), "key", "left_semi").dropDuplicates(["key"])
    parts = F.arrays_zip(_split(F.col("t")).alias("word"), F.split("t", r"\S+", -1).alias("space"))
    words = held.select("key", F.posexplode(parts).alias("i", "x")).select("key", "i", F.col("x.word").alias("w"), F.length("x.space").alias("space"))
    ends = F.sum(F.col("space") + F.length("w")).over(Window.partitionBy("key").orderBy("i"))
    placed = words.where("w is not null").withColumn("at", (ends - F.length("w")).cast("int")).join(found, ["key", "i"], "left_semi")
    start = F.col("at") + F.length(F.regexp_extract("w", rf"^([^{_WORD}+(]*+)", 1))
    return placed.select("key", start.alias("start"), (start + F.length(_core(F.col("w")))).alias("end"))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The text, and 128 bits that stand for id and text."""
    t = text_of(text_col)
    return t, F.struct(F.xxhash64(docs[id_col], t).alias("a"), F.xxhash64(t, F.lit(1), docs[id_col]).alias("b"))


def _context(texts: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """``key, more``: the discovered spans of each text that has any (as many as it has such words); None if none has."""
    found = written(discover(texts, seeds), "found")
    if found.isEmpty():
        return None
    span = F.struct(F.col("start"), F.lit(BASE).alias("kind"), F.col("end"))
    return few(written(_placed(texts, found).groupBy("key").agg(F.collect_set(span).cast(_SPAN).alias("more")), "context"))


def _joined(df: DataFrame, more: DataFrame | None) -> DataFrame:
    """Add ``spans``: ``base`` with the discovered ones of ``key``."""
    if more is None:
        return df.withColumn("spans", F.col("base"))
    return df.join(more, "key", "left").withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, key, base, spans``: spans are structs of start, number of the kind, end."""
    t, key = _keyed(docs, id_col, text_col)
    texts = docs.select(docs[id_col].alias("id"), t.alias("t"), key.alias("key"))
    parts = written(with_spans(texts, seeds=True).drop("t"), "spans")
    more = _context(texts.select("key", "t"), parts.where("size(seeds) > 0").select(F.inline("seeds")))
    return _joined(parts.drop("seeds"), more).select(F.col("id").alias(id_col), "key", "base", "spans")


def _redacted(t: Column, spans: Column) -> Column:
    """The text with its spans (in order) replaced by their kinds; of overlapping ones the first stays."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), out.alias("out"))

    def chunk(a: Column, some: Column) -> Column:
        def inside(x: Column) -> Column:  # x: the text from a.at to the chunk's last end
            def step(r: Column, s: Column) -> Column:
                new = F.concat(r["out"], F.substring(x, r["at"] - a["at"] + 1, s["start"] - r["at"]), F.element_at(names, s["kind"] + 1))
                return F.when(s["start"] >= r["at"], state(s["end"], new)).otherwise(r)

            return F.aggregate(some, state(a["at"], F.lit("")), step, lambda r: state(r["at"], F.concat(a["out"], r["out"])))

        return _let(F.substring(t, a["at"] + 1, F.array_max(F.transform(some, lambda s: s["end"])) - a["at"]), inside)

    return F.aggregate(_chunks(spans), state(F.lit(0), F.lit("")), chunk, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; of overlapping ones the first stays.

    Texts are read again and not shuffled: only discovered spans are joined.
    """
    t, key = _keyed(docs, id_col, text_col)
    texts = docs.select(t.alias("t"), key.alias("key"))
    seeds = written(with_spans(texts, seeds=True).where("size(seeds) > 0").select(F.inline("seeds")), "seeds")
    more = _context(texts.select("key", "t"), seeds)
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), t.alias("t"), key.alias("key"))
    out = _joined(with_spans(whole), more)
    clean = F.when(F.size("spans") > 0, _redacted(F.col("t"), F.col("spans"))).otherwise(F.col(f"row.`{text_col}`"))
    return out.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    out = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS[:BASE])]
    return out.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))

