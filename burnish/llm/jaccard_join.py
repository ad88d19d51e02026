"""N-gram Jaccard self-join by vertical partitioning.

Shingles have one global order, that of their hashes. Cut into `k` ranges, every document falls into `k` fragments.
Two sets whose symmetric difference is at most `d` agree in at least `k - d` fragments, so documents meet only where a
whole fragment is equal, and a document of which too few fragments occur elsewhere is done. The pairs that remain are
decided exactly: partial overlaps are counted fragment by fragment and added up per pair.

Shuffle files go after each large step, so the disk holds the tables and the files of one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.operators.dedup import dedup_keep_first
from burnish.llm.common import components, let_go, mix, saved, shingles, slices, texts

U = np.uint64
BUCKET_ROWS = 2_000_000  # fragments that one task brings together
BROADCAST_ROWS = 1_000_000  # document ids (16 MB) that a task may hold whole; more are joined by a shuffle
PARTS = 8  # ranges of the order in which overlaps are counted
PAIRED = 64  # sets of one signature that are paired one by one; more are compared as a group


class Fragments:
    """How many fragments a set of a size has, for a threshold of `num / den`."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        growth, sizes = max(1.3, den / num + 0.01), [1]
        while sizes[-1] < 1 << 40:
            sizes.append(max(sizes[-1] + 1, int(sizes[-1] * growth)))
        self.top = np.array(sizes, np.int64)  # the largest size of each level
        self.differ = 2 * (den - num) * self.top // (den + num)
        self.spare = np.maximum(2, self.differ // 4)
        self.count = self.differ + 1 + self.spare

    def level(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, n)

    def signatures(self, token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Signature, document, and how many signatures a linked document shares at least, for each fragment.

        Sets of neighbouring levels can be linked, so a set near the top of its level has fragments of the next one,
        too. Agreeing fragments may be empty. Sets with more empty fragments than can be spared also meet by the first
        shingles of the order, of which linked sets share one.
        """
        out = []
        own = self.level(n)
        place = np.arange(len(token)) - (np.cumsum(n) - n)[doc]
        for step in (0, 1):
            level = own + step
            there = (n > 0) & ((step == 0) | (n * self.den // self.num > self.top[own]))
            sub = there[doc]
            t, d, p = token[sub], doc[sub], place[sub]
            if not len(t):
                continue
            k = self.count[level]
            fragment = ((t >> U(32)) * k[d].astype(U)) >> U(32)
            new = np.ones(len(t), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (fragment[1:] != fragment[:-1])
            start = np.flatnonzero(new)
            who = d[start]
            key = np.add.reduceat(mix(t ^ U(0x5BD1E995)), start) + fragment[start] * U(0xD6E8FEB86659FD93)
            out.append((mix(key + level[who].astype(U) * U(0xA0761D6478BD642F)), who))
            empty = k - np.bincount(who, minlength=len(n))
            few = there & (empty > self.spare[level])
            first = few[d] & (p < (n - (n * self.num + self.den - 1) // self.den + 1)[d])
            key = t[first] + (level[d[first]].astype(U) + U(1)) * U(0xE7037ED1A0B428DB)
            out.append((mix(key), d[first]))
        if not out:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def needed(self, token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many signatures of a set must occur elsewhere for a link, at the level that asks for fewer."""
        own = self.level(n)
        least = np.full(len(n), 1 << 40, np.int64)
        for step in (0, 1):
            level = own + step
            there = (n > 0) & ((step == 0) | (n * self.den // self.num > self.top[own]))
            k = self.count[level]
            fragment = ((token >> U(32)) * k[doc].astype(U)) >> U(32)
            new = np.ones(len(token), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (fragment[1:] != fragment[:-1])
            spare = self.spare[level] - (k - np.bincount(doc[new], minlength=len(n)))
            least = np.where(there, np.minimum(least, np.maximum(0, spare) + 1), least)
        return least


def fingerprints(token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal ones."""
    total = np.zeros(len(n), U)
    if len(token):
        filled = np.flatnonzero(n > 0)
        total[filled] = np.add.reduceat(mix(token + U(0x9FB21C651E98DF25)), (np.cumsum(n) - n)[filled])
    return mix(total + n.astype(U))


def shingle_sets(docs: DataFrame, size: int, plan: Fragments) -> DataFrame:
    """`doc_id`, `row_hash` (of the text), `n_shingles`, `fp` (equal for equal sets), `needed` (shared signatures) of
    every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            token, doc = shingles(texts(part), size)
            n = np.bincount(doc, minlength=part.num_rows)
            fp = fingerprints(token, doc, n).view(np.int64)
            numbers = [pa.array(x, pa.int64()) for x in (n, fp, plan.needed(token, doc, n))]
            columns = [part.column(0).cast(pa.int64()), part.column(2), *numbers]
            yield pa.record_batch(columns, ["doc_id", "row_hash", "n_shingles", "fp", "needed"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    return rows.mapInArrow(counted, "doc_id long, row_hash long, n_shingles long, fp long, needed long")


def _runs(sig: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, set) sorted, with the number of its signature's run; then the starts of the runs."""
    order = np.lexsort((fp, sig))
    sig, fp = sig[order], fp[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
    sig, fp = sig[new], fp[new]
    first = np.ones(len(sig), dtype=bool)
    first[1:] = sig[1:] != sig[:-1]
    return sig, fp, np.flatnonzero(first)


def _stars(sig: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Centres (one a signature), and (signature, set, centre) of all other sets of a signature."""
    sig, fp, start = _runs(sig, fp)
    if not len(sig):
        return sig, fp, sig, fp, fp
    centre = np.repeat(fp[start], np.diff(np.append(start, len(sig))))
    rest = fp != centre
    return sig[start], fp[start], sig[rest], fp[rest], centre[rest]


def equal_fragments(docs: DataFrame, size: int, plan: Fragments, buckets: int) -> DataFrame:
    """`g`, `fp`, `centre`: set `fp` shares signature `g` with set `centre`.

    A task sends one set per signature to the bucket of the signature and keeps the others as members of that set, so
    a signature that a third of all documents have reaches its bucket once per task. Members pass through buckets of
    their own, dealt out by set.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            token, doc = _shingles_in_steps(part, size)
            n = np.bincount(doc, minlength=part.num_rows)
            fp = fingerprints(token, doc, n)
            _, one = np.unique(fp, return_index=True)
            only = np.zeros(len(n), dtype=bool)
            only[one] = True
            own = only[doc]
            sig, who = plan.signatures(token[own], _dense(doc[own], only), n[only])
            sig, fp, of, member, centre = _stars(sig, fp[only][who])
            bucket = ((sig >> U(32)) * U(buckets)) >> U(32)
            order = np.lexsort((fp, bucket))
            sig, fp, bucket = sig[order], fp[order], bucket[order]
            rows = []
            for lo, hi, b in _spans(bucket):
                new = np.flatnonzero(np.append(True, fp[lo + 1 : hi] != fp[lo : hi - 1]))
                count = np.diff(np.append(new, hi - lo)).astype("<u4")
                low = sig[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                rows.append((b, low, fp[lo:hi][new].tobytes(), count.tobytes(), b""))
            away = member % U(buckets)
            order = np.argsort(away, kind="stable")
            of, member, centre, away = of[order], member[order], centre[order], away[order]
            for lo, hi, b in _spans(away):
                rows.append((-1 - b, of[lo:hi].tobytes(), member[lo:hi].tobytes(), b"", centre[lo:hi].tobytes()))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "sig", "fp", "count", "centre"]
                )

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        if bucket < 0:
            of, member, centre = (np.frombuffer(b"".join(rows[c]), "<u8") for c in ("sig", "fp", "centre"))
        else:
            raw = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, 6)
            sig = np.zeros((len(raw), 8), np.uint8)
            sig[:, :6] = raw
            sig = sig.view("<u8").ravel()
            fp = np.repeat(np.frombuffer(b"".join(rows["fp"]), "<u8"), np.frombuffer(b"".join(rows["count"]), "<u4"))
            _, _, of, member, centre = _stars(sig, fp)
        # Either side knows the signature's low 48 bits.
        of = mix((of & U((1 << 48) - 1)) + U(1))
        columns = {"g": of, "fp": member, "centre": centre}
        return pd.DataFrame({k: np.ascontiguousarray(v).view(np.int64) for k, v in columns.items()})

    blobs = docs.select("doc_id", "text").mapInArrow(
        cut, "bucket long, sig binary, fp binary, count binary, centre binary"
    )
    return blobs.groupBy("bucket").applyInPandas(met, "g long, fp long, centre long")


def _shingles_in_steps(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """`shingles` of a large batch: words take some thirty times the text's bytes, so less is worked on at a time."""
    tokens, docs, row = [], [], 0
    for step in slices(iter([part])):
        token, doc = shingles(texts(step), size)
        tokens.append(token)
        docs.append(doc + row)
        row += step.num_rows
    return np.concatenate(tokens), np.concatenate(docs)


def _dense(doc: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return (np.cumsum(chosen) - 1)[doc]


def _spans(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_keys):
        edge = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
        edge = [0, *edge.tolist(), len(sorted_keys)]
        for lo, hi in zip(edge, edge[1:]):
            yield lo, hi, int(sorted_keys[lo])


def set_parts(docs: DataFrame, size: int) -> DataFrame:
    """`fp`, `n`, `part`, `tokens`: the set of each document in `PARTS` ranges of the global order."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            token, doc = shingles(texts(batch), size)
            n = np.bincount(doc, minlength=batch.num_rows)
            fp = fingerprints(token, doc, n).view(np.int64)
            key = doc * PARTS + (token >> U(61)).astype(np.int64)
            spans = [*_spans(key)]
            lo, of = np.array([s[0] for s in spans], np.int64), np.array([s[2] for s in spans], np.int64)
            offsets = pa.array(np.append(lo, len(token)), pa.int32())
            yield pa.record_batch(
                [
                    pa.array(fp[of // PARTS], pa.int64()),
                    pa.array(n[of // PARTS], pa.int64()),
                    pa.array(of % PARTS, pa.int32()),
                    pa.ListArray.from_arrays(offsets, pa.array(token.view(np.int64), pa.int64())),
                ],
                ["fp", "n", "part", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(parts, "fp long, n long, part int, tokens array<long>")


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (`a`, `b`) with an intersection of at least num / den of their union."""
    a = sets.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), "part", F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), "part", F.col("tokens").alias("tokens_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, ["b", "part"])
    both = both.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    partial = both.select("a", "b", "n_a", "n_b", "part", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"))
    # A set that is there twice, under a repeated id, counts once.
    partial = partial.groupBy("a", "b", "n_a", "n_b", "part").agg(F.max("common").alias("common"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return total.where(den * F.col("common") >= num * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def best_centres(groups: DataFrame) -> DataFrame:
    """`a`, `b`: for each set the centre with which it shares the most signatures.

    The centre of a signature is its set with the most company: the original among its copies, if it is there.
    """
    size = groups.groupBy("g").agg(F.count("*").alias("size"))
    company = groups.join(size, "g").groupBy("fp").agg(F.sum("size").alias("company"))
    known = groups.join(company, "fp")
    centre = known.groupBy("g").agg(F.max_by("fp", F.struct("company", "fp")).alias("centre"))
    each = known.join(centre, "g").where("fp <> centre").groupBy("fp", "centre").agg(F.count("*").alias("same"))
    best = each.groupBy("fp").agg(F.max_by("centre", F.struct("same", "centre")).alias("b"))
    return best.select(F.col("fp").alias("a"), "b")


def undecided(groups: DataFrame, label: DataFrame, alive: DataFrame, num: int, den: int) -> DataFrame:
    """`fp`, `low`: edges between sets. Linked sets of different labels are in one component of them.

    Such sets share at least as many signatures as each needs, all of them mixed ones: of several labels. In an order of
    the signatures, rare ones first, they still share one if each set leaves out its last ones, one fewer than it needs.
    Where up to `PAIRED` sets meet, each pair gets an edge if it shares enough signatures in all. Sets that meet by
    chance, ever more of them in more rows, end here. Where more sets meet, all have an edge to the lowest one.
    """
    placed = groups.join(label, "fp", "left").select("g", "fp", F.coalesce("component", "fp").alias("label"))
    mixed = placed.groupBy("g").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most"))
    mixed = placed.join(mixed.where("least < most").select("g", "size"), "g")
    lists = mixed.groupBy("fp", "label").agg(F.sort_array(F.collect_list(F.struct("size", "g"))).alias("held"))
    lists = lists.join(alive.select("fp", "n_shingles", "needed"), "fp").where(F.size("held") >= F.col("needed"))
    lists = saved(lists.select("fp", "label", "n_shingles", "needed", F.col("held.g").alias("held")))
    let_go(groups.sparkSession)
    kept = F.slice("held", F.lit(1), (F.size("held") - F.greatest("needed", F.lit(1)) + 1).cast("int"))
    meets = lists.select("fp", "label", F.explode(kept).alias("g"))
    met = meets.groupBy("g").agg(
        F.count("*").alias("size"), F.min("fp").alias("low"), F.min("label").alias("least"), F.max("label").alias("most")
    )
    meets = meets.join(met.where("least < most").select("g", "size", "low"), "g")
    few = meets.where(F.col("size") <= PAIRED).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("fp", "label"))).alias("sets"))
    others = F.filter("sets", lambda other: (other["fp"] > F.col("one.fp")) & (other["label"] != F.col("one.label")))
    pairs = few.select("sets", F.explode("sets").alias("one")).select(F.col("one.fp").alias("a"), F.explode(others["fp"]).alias("b"))
    side = lambda end: lists.select(
        F.col("fp").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n_shingles", "needed", "held"))
    )
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    both = both.where(den * F.least("n_shingles_a", "n_shingles_b") >= num * F.greatest("n_shingles_a", "n_shingles_b"))
    enough = F.size(F.array_intersect("held_a", "held_b")) >= F.greatest("needed_a", "needed_b")
    many = meets.where(F.col("size") > PAIRED).select("fp", "low")
    return both.where(enough).select(F.col("b").alias("fp"), F.col("a").alias("low")).unionByName(many).distinct()


def links_in_blocks(apart: DataFrame, sets: DataFrame, plan: Fragments) -> DataFrame:
    """Links (`a`, `b`) that join the sets of `apart` (edges `fp`, `low`) to the components that all their links make.

    Sets that these edges bring together, directly or by way of others, are dealt out into blocks of one level of size. Each two blocks of the
    same or neighbouring levels come together in one task, which adds up the partial overlaps of all pairs and hands on
    a spanning forest of the links: no more rows than sets.
    """
    meet = components(apart.select(F.col("fp").alias("a"), F.col("low").alias("b")))
    sizes = sets.groupBy("fp").agg(F.first("n").alias("n"))
    level = F.lit(0)
    for k, top in enumerate(plan.top[:-1].tolist()):
        level = F.when(F.col("n") > top, k + 1).otherwise(level)
    placed = meet.select(F.col("node").alias("fp"), F.col("component").alias("meet")).join(sizes, "fp")
    placed = saved(placed.withColumn("level", level))
    room = F.greatest(F.lit(16), F.least(F.lit(512), (F.lit(1 << 18) / F.max("n")).cast("int")))
    blocks = placed.groupBy("meet", "level").agg(F.ceil(F.count("*") / room).cast("int").alias("blocks"))
    after = blocks.select("meet", (F.col("level") - 1).alias("level"), F.col("blocks").alias("up"))
    before = blocks.select("meet", (F.col("level") + 1).alias("level"), F.col("blocks").alias("down"))
    dealt = placed.join(blocks, ["meet", "level"]).join(after, ["meet", "level"], "left").join(before, ["meet", "level"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    task = lambda lo, i, hi, j: F.struct(lo.alias("lo"), i.alias("i"), hi.alias("hi"), j.alias("j"))
    count = lambda n: F.sequence(F.lit(1), F.coalesce(n, F.lit(0)))
    some = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, count(n)).otherwise(F.array().cast("array<int>"))
    here = F.transform(
        some(F.col("blocks")),
        lambda j: task(F.col("level"), F.least(F.col("own"), j - 1), F.col("level"), F.greatest(F.col("own"), j - 1)),
    )
    up = F.transform(some(F.col("up")), lambda j: task(F.col("level"), F.col("own"), F.col("level") + 1, j - 1))
    down = F.transform(some(F.col("down")), lambda j: task(F.col("level") - 1, j - 1, F.col("level"), F.col("own")))
    dealt = dealt.withColumn("own", own).select("meet", "level", "own", "fp", F.explode(F.concat(here, up, down)).alias("task"))
    num, den = plan.num, plan.den

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["fp", "part"])
        first = rows.drop_duplicates("fp")
        fps, n = first["fp"].to_numpy(), first["n"].to_numpy()
        at = {f: k for k, f in enumerate(fps.tolist())}
        common = np.zeros((len(fps), len(fps)), np.float32)
        for _, part in rows.groupby("part"):
            who = np.repeat([at[f] for f in part["fp"].tolist()], [len(t) for t in part["tokens"]])
            _, token, often = np.unique(np.concatenate(part["tokens"].tolist()), return_inverse=True, return_counts=True)
            keep = often[token] > 1
            token, who = np.unique(token[keep], return_inverse=True)[1], who[keep]
            order = np.argsort(token, kind="stable")
            token, who = token[order], who[order]
            for lo in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
                a, b = np.searchsorted(token, [lo, lo + 4096])
                has = np.zeros((len(fps), 4096), np.float32)
                has[who[a:b], token[a:b] - lo] = 1
                common += has @ has.T
        common = common.astype(np.int64)
        near = den * common >= num * (n[:, None] + n[None, :] - common)
        left, tree = np.ones(len(fps), dtype=bool), []
        for root in range(len(fps)):
            if not left[root]:
                continue
            left[root], edge = False, [root]
            while edge:
                k = edge.pop()
                new = np.flatnonzero(near[k] & left)
                left[new] = False
                tree += [(fps[j], fps[k]) for j in new]
                edge += new.tolist()
        return pd.DataFrame(tree, columns=["a", "b"], dtype=np.int64)

    return dealt.select("meet", "task", "fp").join(sets, "fp").groupBy("meet", "task").applyInPandas(compare, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`doc_id`, `row_hash`, `n_shingles`, `component_id`, `component` of every row of `docs`; `row_hash` is that of the
    text, `component` a number of the component's own.

    Rows link when the Jaccard similarity of their shingle sets is at least num / den; `component_id` is the smallest
    doc_id reachable by links. Words are lower-cased (A-Z) runs without ASCII white space; a text of fewer than `size`
    words is one shingle. Null texts and texts without words have no shingle and link with nothing. Rows with a null
    doc_id keep a null component. Repeated ids are rows of their own. Other columns are left aside. No row gives none.

    Equal sets are one node, so copies are never paired. Documents of one near-copy group are first compared with a
    centre; where this leaves sets apart that share enough signatures, their groups are compared each with each, block
    by block.
    """
    plan = Fragments(num, den)
    rows = saved(shingle_sets(docs, size, plan))
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("fp").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("needed").alias("needed")
    )
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(8, int(total * 0.45) // BUCKET_ROWS)
    members = saved(equal_fragments(docs.where("doc_id is not null"), size, plan, buckets))
    let_go(docs.sparkSession)
    ends = members.select("g", "fp").unionByName(members.select("g", F.col("centre").alias("fp")))
    groups = saved(ends.distinct())
    shared = groups.groupBy("fp").agg(F.count("*").alias("shared"))
    alive = saved(shared.join(classes, "fp").where("shared >= needed").drop("shared"))

    ids = alive.select(F.col("first_id").alias("doc_id"))
    if alive.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    sets = saved(set_parts(docs.join(ids, "doc_id", "left_semi"), size))

    groups = saved(groups.join(alive.select("fp"), "fp", "left_semi"))
    best = saved(best_centres(groups))
    let_go(docs.sparkSession)
    links = saved(linked(best, sets, num, den))
    let_go(docs.sparkSession)
    label = components(links).select(F.col("node").alias("fp"), "component")
    apart = saved(undecided(groups, label, alive, num, den))
    let_go(docs.sparkSession)
    links = saved(links.unionByName(links_in_blocks(apart, sets, plan)))
    let_go(docs.sparkSession)

    node = components(links).select(F.col("node").alias("fp"), "component")
    joined = classes.join(node, "fp", "left")
    lowest = joined.where("component is not null").groupBy("component").agg(F.min("first_id").alias("lowest"))
    final = joined.join(lowest, "component", "left").select(
        "fp", F.coalesce("lowest", "first_id").alias("component_id"), F.coalesce("component", "fp").alias("component")
    )
    kept = rows.join(final, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return kept.select("doc_id", "row_hash", "n_shingles", own.alias("component_id"), "component")


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs`, all columns, that stand for their component: that of the smallest doc_id, and of its rows, if
    the id is repeated, one. Rows that link with nothing stay, also those without text or id."""
    rows = saved(jaccard_components(docs, size, num, den).where("doc_id is not null and n_shingles > 0"))
    let_go(docs.sparkSession)
    first = rows.where("doc_id = component_id").groupBy("component").agg(F.min("row_hash").alias("first_hash"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("row_hash") == F.col("first_hash"))
    gone = rows.join(first, "component").where(~stays).select("doc_id", "row_hash").distinct()
    gone = saved(gone.select(F.col("doc_id").alias("__gone_id"), F.col("row_hash").alias("__gone_hash")))
    again = rows.groupBy("doc_id", "row_hash").count().where("count > 1")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = (F.col("doc_id") == F.col("__gone_id")) & (F.xxhash64("text") == F.col("__gone_hash"))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    # Rows of the same id and text: without words or id they all stay, of any others the first by their other columns.
    worded = F.col("doc_id").isNotNull() & F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    return dedup_keep_first(left.where(worded), ["doc_id", "text"], ["doc_id"]).unionByName(left.where(~worded))
