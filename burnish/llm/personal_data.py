"""Personal data: base patterns with positions, and bootstrapped contextual extraction of what they don't know.

Base spans are seeds, each as a whole. The words in front of them are lexical patterns; every identifier-like word, or
run of words of digits, that follows a pattern is an instance. Patterns and instances score each other in turns on that
graph, and confident patterns add the instances that the base patterns miss. All of it is made of DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.text import named
from burnish.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
#: The given patterns, written so that no text takes quadratic time: a run that can't match isn't tried again from its
#: middle, and what can't be given back is taken at once. A single digit counts as a card of one digit, and is dropped.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character without which a pattern can't match.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word of digits, and runs of them with 7 to 19 digits: an identifier written in several words.
NUMBER = r"[+(]{0,2}[0-9]++[)]?(?:[.-][0-9]++){0,2}+"
RUN = rf"(?<!\S){NUMBER}(?: {NUMBER}(?![^\s,;:!?.)\]]))++"
RUN_DIGITS = (7, 19)
#: Words with a digit or an @, and what an instance of each kind looks like at least.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
LOOKS = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9a-fA-F]+([.:][0-9a-fA-F]+){3,7}$",
    "card": r"^[0-9][0-9 -]{10,21}[0-9]$",
    "phone": r"^[+(]{0,2}[0-9][0-9(). -]{5,17}[0-9]$",
}
CONTEXT_CHARS = 80
ROUNDS = 3
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8
OWN_ID, OWN_HASH, OWN_ADDED = "__redacted_id", "__redacted_hash", "__redacted_added"
BROADCAST_ROWS = 200_000  # rows with added spans that a task may hold whole; more are joined by a shuffle

SPANS = "array<struct<start:int,end:int,value:string,lead:string>>"
BLOCK = 256  # matches whose array grows one by one; blocks of them are put together at the end


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: code points `start` and `end`, `value`, and the CONTEXT_CHARS code points in
    front of it as `lead`. What lies between the matches gives the positions, so the text is walked through once."""
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")
    )

    def step(acc, x):
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        lead = F.right(F.concat(acc["tail"], x["before"]), F.lit(CONTEXT_CHARS))
        span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), lead.alias("lead"))
        found = F.when(x["value"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span)))
        tail = F.right(F.concat(lead, F.coalesce(x["value"], F.lit(""))), F.lit(CONTEXT_CHARS))
        return F.struct(end.alias("at"), tail.alias("tail"), found.alias("found"))

    def block(acc, part):
        start = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), F.array().cast(SPANS).alias("found"))
        one = F.aggregate(part, start, step)
        # A name for the block's result, which is taken apart.
        return F.transform(
            F.array(one),
            lambda o: F.struct(o["at"].alias("at"), o["tail"].alias("tail"), F.concat(acc["out"], F.array(o["found"])).alias("out")),
        )[0]

    def whole(all_steps):
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int"))
        parts = F.transform(numbers, lambda b: F.slice(all_steps, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{SPANS}>").alias("out"))
        return F.aggregate(parts, start, block, lambda acc: F.flatten(acc["out"]))

    return F.transform(F.array(steps), whole)[0]


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{PART}(\.{PART}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    """Valid matches of one kind; matches that fail are not retried."""
    found = F.filter(matches(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))
    if NEEDED[kind]:
        return F.when(F.contains(text, F.lit(NEEDED[kind])), found).otherwise(F.array().cast(SPANS))
    return found


def _places(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind as `start`, `end` (exclusive) in code points."""
    return _places(_base(text, kind))


def scan(docs: DataFrame) -> DataFrame:
    """`row`, `doc_id`, `row_hash` (of the text), the base spans of each kind, and the candidates with the two words in
    front of them, or the one at the beginning of a text.

    Candidates are the base spans, the runs of words of digits and the words with a digit or an @. A run that overlaps
    a base span is none, nor is a word that overlaps a base span or lies in a run. Of a context, CONTEXT_CHARS code
    points are looked at.
    """
    text = F.coalesce("text", F.lit(""))

    def meets(x, spans):
        return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))

    def candidate(x, seed):
        before = F.regexp_replace(F.lower(F.regexp_extract(x["lead"], r"((?:\S+\s+)?\S+)\s+\S*$", 1)), "[0-9]", "0")
        # A word or run that is none of the base spans meets none of them.
        kinds = [(meets(x, F.col(k)) if seed else F.lit(False)).alias(k) for k in KINDS]
        return F.struct(x["start"].alias("start"), x["value"].alias("value"), before.alias("lead"), F.lit(seed).alias("seed"), *kinds)

    def clear(x, *others):
        return reduce(lambda a, b: a & b, [~meets(x, F.col(o)) for o in others])

    has = F.regexp_like(text, F.lit("[0-9@]"))
    none = F.array().cast(SPANS)
    runs = F.filter(matches(text, RUN), lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]", "")).between(*RUN_DIGITS))
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("row_hash"),
        *[_base(text, k).alias(f"base_{k}") for k in KINDS],
        F.when(F.regexp_like(text, F.lit("[0-9][)]? [+(]{0,2}[0-9]")), runs).otherwise(none).alias("runs"),
        F.when(has, matches(text, CANDIDATE)).otherwise(none).alias("words"),
    )
    rows = rows.select("*", *[_places(F.col(f"base_{k}")).alias(k) for k in KINDS])
    rows = rows.withColumn("runs", F.filter("runs", lambda x: clear(x, *KINDS)))
    seeds = [F.transform(f"base_{k}", lambda x: candidate(x, True)) for k in KINDS]
    runs = F.transform("runs", lambda x: candidate(x, False))
    words = F.transform(F.filter("words", lambda x: clear(x, *KINDS, "runs")), lambda x: candidate(x, False))
    rows = rows.withColumn("candidates", F.concat(*seeds, runs, words))
    return saved(rows.select("doc_id", "row_hash", *KINDS, "candidates", F.monotonically_increasing_id().alias("row")))


def _instances(rows: DataFrame) -> DataFrame:
    """One row per candidate and pattern: `row`, `start`, `end`, `value`, `pattern`, and for each kind whether a base
    span of it overlaps (a seed). Punctuation around a word or run doesn't belong to it."""
    one = rows.select("row", F.explode("candidates").alias("c"))
    core = F.when(F.col("c.seed"), F.col("c.value")).otherwise(F.regexp_extract("c.value", r"[0-9A-Za-z+(].*[0-9A-Za-z)]", 0))
    start = F.col("c.start") + F.greatest(F.instr(F.col("c.value"), core) - 1, F.lit(0))
    one = one.withColumn("value", core).withColumn("start", start).where(F.length("value") > 0)
    one = one.withColumn("end", F.col("start") + F.length("value"))
    one = one.select("row", "start", "end", "value", F.col("c.lead").alias("lead"), *[F.col(f"c.{k}").alias(k) for k in KINDS])
    words = F.split(F.trim("lead"), r"\s+")
    patterns = F.array_distinct(F.array(F.concat_ws(" ", words), F.element_at(words, -1)))
    # Words, not the first part of a number.
    return one.withColumn("pattern", F.explode(patterns)).where(F.regexp_like("pattern", F.lit(r"\p{L}\S*$")))


def confident_patterns(found: DataFrame) -> DataFrame:
    """`pattern`, `kind` of the patterns whose instances are of one kind with enough confidence, after some rounds.

    A pattern's confidence is the mean score of its distinct instances, one unknown instance added. An instance that is
    a seed scores 1 for its kind and 0 for others; any other scores as its patterns together make it likely, if it looks
    like the kind. Patterns with fewer than MIN_SEEDS distinct seeds prove nothing.
    """
    edges = found.groupBy("pattern", "value").agg(*[F.max(k).alias(k) for k in KINDS])
    seeded = reduce(lambda a, b: a | b, [F.col(k) for k in KINDS])
    edges = edges.withColumn("seed", seeded)
    edges = saved(edges.select("pattern", "value", "seed", *KINDS))
    score = edges.select("value", *[F.when(F.col(k), 1.0).otherwise(0.0).alias(f"s_{k}") for k in KINDS], "pattern")
    for turn in range(ROUNDS):
        confidence = score.groupBy("pattern").agg(
            *[(F.sum(f"s_{k}") / (F.count("*") + 1)).alias(f"c_{k}") for k in KINDS]
        )
        if turn == ROUNDS - 1:
            break
        joined = edges.join(confidence, "pattern")
        unlikely = joined.groupBy("value").agg(
            *[F.sum(F.log(F.greatest(1 - F.col(f"c_{k}"), F.lit(1e-9)))).alias(f"u_{k}") for k in KINDS]
        )
        likely = [
            F.when(F.col("seed"), F.col(k).cast("double"))
            .when(F.regexp_like("value", F.lit(LOOKS[k])), 1 - F.exp(F.col(f"u_{k}")))
            .otherwise(0.0)
            .alias(f"s_{k}")
            for k in KINDS
        ]
        score = saved(edges.join(unlikely, "value").select("pattern", "value", *likely))
    seeds = edges.groupBy("pattern").agg(*[F.sum(F.col(k).cast("long")).alias(f"n_{k}") for k in KINDS])
    both = confidence.join(seeds, "pattern")
    kinds = F.array(
        *[
            F.when((F.col(f"c_{k}") >= MIN_CONFIDENCE) & (F.col(f"n_{k}") >= MIN_SEEDS), F.lit(k))
            for k in KINDS
        ]
    )
    return both.select("pattern", F.explode(F.array_compact(kinds)).alias("kind"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """`doc_id`, `row_hash`, base spans of each kind, and `added`: an array of `kind`, `start`, `end` that the bootstrap adds.

    One row per row of `docs`, repeated ids included. Null and empty texts have no spans; an empty table gives no row;
    other columns are left aside.
    """
    rows = scan(docs)
    found = _instances(rows)
    patterns = confident_patterns(found)
    unknown = found.where(~reduce(lambda a, b: a | b, [F.col(k) for k in KINDS]))
    looks = F.coalesce(*[F.when(F.col("kind") == k, F.regexp_like("value", F.lit(LOOKS[k]))) for k in KINDS])
    added = unknown.join(patterns, "pattern").where(looks).select("row", "kind", "start", "end").distinct()
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.join(added, "row", "left").select("doc_id", "row_hash", *KINDS, F.coalesce("added", none).alias("added"))


def personal_data_table(docs: DataFrame) -> DataFrame:
    """`doc_id`, counts of base spans, `base_sha256` and `spans`, as kind:start:end by kind, then start."""
    found = find_personal_data(docs)

    def texts(spans, k):
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))

    base = F.concat(*[texts(F.col(k), k) for k in KINDS])

    def every(k):
        own = F.transform(F.filter("added", lambda s: s["kind"] == k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return texts(F.sort_array(F.concat(F.col(k), own)), k)

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(every, KINDS)), ",").alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs`, all rows and columns, with each span in `text` replaced by its kind, as [EMAIL]; spans that overlap are
    replaced together, under the kind of the first. Null texts stay null. `n_chars`, if there, follows the text."""
    added = find_personal_data(docs).where(F.size("added") > 0)
    added = added.select(
        F.col("doc_id").alias(OWN_ID), F.col("row_hash").alias(OWN_HASH), F.array_sort("added").alias(OWN_ADDED)
    )
    added = saved(added.distinct())
    if added.count() <= BROADCAST_ROWS:
        added = F.broadcast(added)
    same = F.col("doc_id").eqNullSafe(F.col(OWN_ID)) & (F.xxhash64("text") == F.col(OWN_HASH))
    joined = docs.join(added, same, "left")
    text = F.coalesce("text", F.lit(""))

    def labelled(spans, label):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("kind")))

    spans = [labelled(base_spans(text, k), lambda s, k=k: F.lit(k)) for k in KINDS]
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    spans.append(F.coalesce(labelled(F.col(OWN_ADDED), lambda s: s["kind"]), none))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        clear = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(clear, label))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    def close(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    clean = F.aggregate(F.sort_array(F.concat(*spans)), start, step, close)
    risky = F.col(OWN_ADDED).isNotNull() | F.regexp_like(text, F.lit("[0-9@]"))
    out = joined.withColumn("text", F.when(risky & F.col("text").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*map(named, docs.columns))
