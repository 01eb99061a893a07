"""Exact self-join of texts on the Jaccard similarity of their word shingles, by multiple-global-order filtering.

If two sets reach the threshold, then under *any* total order of the shingles both must have a common shingle among the
first ``n - ceil(t * n) + 1`` of their own. A candidate pair has to pass that prefix test under several orders, and only
what is left gets its sets compared:

* order 1 (hashes; a bounded list of the commonest shingles last), with prefixes half as long again: so many more
  shingles must be common, and a set too few of whose longer prefix stand in other sets' prefixes can't have a link;
* order 2, among the sets that pass: shingles in few sets first. What stands in one set only can't be common, so sets
  with enough shingles of their own are out, and the blocks of the others are small;
* orders 1, 3 and 4 (rehashed) once more for each candidate pair, from packed prefixes, before the sets move.

Large groups of near copies. Every set has a *home*, a set that leads most of
its blocks, and is told by its difference D from it. With ``|x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|`` two sets of one home
reach the threshold only if their differences have so many shingles in common as makes up for what both differ. Sets
near enough to the home are linked with it; a pair with a set that is not needs common shingles in the *differences*, and the
prefix test holds there too: their rarest shingles, which near copies don't share. Pairs of different homes meet in the
blocks of order 2.

Blocks of sets that are not near their home, yet near each other, are thinned by leaders before any pair is made: in each round
every set is held against one other only, the leader of most of its blocks, and what links joins a part. A pair within one part
tells nothing new, so blocks of one part go, and in the others only pairs of different parts are made. No pair of different
parts is dropped, and nothing is capped or sampled.

Defined results: A-Z are lower-cased, words are runs of non-space bytes, a text with fewer than five words has one
shingle, a null or blank text has none and links with nothing; a null id keeps its row and its class but never becomes
a component's id; repeated rows are linked with each other; other columns are dropped. Shingles and sets are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.textbytes import mix, shingle_sets, slices
from corpusloom.runtime import broadcast_if_small, checkpointed, free_name, quoted

#: Similarity in hundredths.
SIMILARITY = 75
#: Entries of the list of common shingles (16 bytes each): bounds what each task holds. Any list gives the same result.
COMMON_LIST = 200_000
#: Copies of a shingle within one batch of documents that make it a candidate for that list.
COMMON_IN_BATCH = 2
#: Rounds of leaders before pairs are made; any number gives the same components.
LEADER_ROUNDS = 2

_REHASH = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))


def prefix_length(n: int, similarity: int = SIMILARITY) -> int:
    return n - -(-similarity * n // 100) + 1


def class_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.sum(mix(grams), dtype=np.uint64, keepdims=True) ^ np.uint64(len(grams))).view(np.int64)[0])


def gram_sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of each text of a batch."""
    for a, _, buf, off in slices(batch.column(column)):
        for i, grams in enumerate(shingle_sets(buf, off)):
            yield a + i, grams


def sizes_and_common(docs: DataFrame) -> DataFrame:
    """One pass: (id, row, n, cls) of every row, and after each batch (gram, times) of the shingles common in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, names, all_grams = [], [], set(), []
            for _, grams in gram_sets(batch, 2):
                n.append(len(grams))
                cls.append(class_of(grams) if len(grams) else None)
                if len(grams) and cls[-1] not in names:
                    names.add(cls[-1])
                    all_grams.append(grams)
            grams, times = np.unique(np.concatenate(all_grams), return_counts=True) if all_grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = times >= COMMON_IN_BATCH
            grams, times = grams[often].view(np.int64), times[often].astype(np.int64)
            none, own = pa.nulls(len(grams), pa.int64()), pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), none]),
                    pa.concat_arrays([batch.column(1), none]),
                    pa.concat_arrays([pa.array(n, pa.int64()), none]),
                    pa.concat_arrays([pa.array(cls, pa.int64()), none]),
                    pa.concat_arrays([own, pa.array(grams)]),
                    pa.concat_arrays([own, pa.array(times)]),
                ],
                names=["id", "row", "n", "cls", "gram", "times"],
            )

    return docs.mapInArrow(run, "id long, row long, n long, cls long, gram long, times long")


class Orders:
    """The global orders by hash with the listed common shingles last: prefixes of a set under each of them."""

    def __init__(self, common: np.ndarray, times: np.ndarray):
        at = np.argsort(common)
        self.common, self.times = common[at], times[at]

    def split(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The uncommon shingles, and the common ones from the rarer to the commoner."""
        if not len(self.common):
            return grams, grams[:0]
        at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
        is_common = self.common[at] == grams
        often = grams[is_common]
        return grams[~is_common], often[np.lexsort((often, self.times[at[is_common]]))]

    def prefix(self, grams: np.ndarray, order: int) -> np.ndarray:
        p = prefix_length(len(grams))
        rare, often = self.split(grams)
        if order and p < len(rare):
            rare = rare[np.argpartition(mix(rare * _REHASH[order - 1]), p - 1)[:p]]
        return np.concatenate([rare[:p], often[: max(0, p - len(rare))]])


def common_orders(counted: DataFrame) -> Orders:
    """The orders, from (gram, times): the commonest shingles, as many as the list holds; of those that tie at its end some, by a hash."""
    counted = checkpointed(counted)
    per_count = sorted(((r.times, r.n) for r in counted.groupBy("times").agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least, tied, share = 0, None, None, 0
    for times, n in per_count:
        if held + n > COMMON_LIST:
            tied, share = times, int(1000 * (COMMON_LIST - held) / n)
            break
        held, least = held + n, times
    listed = F.lit(False) if least is None else F.col("times") >= least
    if share:
        listed = listed | ((F.col("times") == tied) & (F.pmod(F.xxhash64("gram"), F.lit(1000)) < share))
    if least is None and not share:
        return Orders(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = counted.where(listed).toArrow()
    return Orders(rows["gram"].to_numpy().view(np.uint64), rows["times"].to_numpy())


def long_prefixes(texts: DataFrame, orders: Orders) -> DataFrame:
    """(gram, cls, listed) of each set's longer prefix under order 1.

    Listed shingles are known to be in several sets: they come as one row with their number, under the set's own name.
    A set repeated within a batch counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: set[int] = set()
            grams_out, cls_out, listed = [np.zeros(0, np.uint64)], [], []
            for _, grams in gram_sets(batch, 0):
                if not len(grams) or (cls := class_of(grams)) in names:
                    continue
                names.add(cls)
                q = longer_prefix(len(grams))
                rare, often = orders.split(grams)
                rare, known = rare[:q], min(len(often), max(0, q - len(rare)))
                grams_out += [rare, np.array([cls], np.int64).view(np.uint64)] if known else [rare]
                cls_out.append(np.full(len(rare) + bool(known), cls))
                listed.append(np.zeros(len(rare) + bool(known), np.int32))
                if known:
                    listed[-1][-1] = known
            if cls_out:
                arrays = [np.concatenate(grams_out).view(np.int64), np.concatenate(cls_out), np.concatenate(listed)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["gram", "cls", "listed"])

    return texts.mapInArrow(run, "gram long, cls long, listed int")


def longer_prefix(n: int) -> int:
    """The shortest prefix and half as many more: linked sets have 1 + half as many shingles of the smaller's in common."""
    p = prefix_length(n)
    return p + p // 2


def may_have_links(texts: DataFrame, orders: Orders, classes: DataFrame) -> DataFrame:
    """(cls, head) of the sets with enough shingles of other sets' longer prefixes in their own.

    Of two linked sets the one whose prefix ends first in the order has all but ``n - ceil(t * n)`` of it in the other's
    prefix. That one may be as small as ``t`` times the other, so the smallest partner's number is asked for.
    """
    block = Window.partitionBy("gram")
    placed = long_prefixes(texts, orders).withColumn("least", F.min("cls").over(block)).withColumn("most", F.max("cls").over(block))
    met = placed.where("least <> most or listed > 0").groupBy("cls").agg(F.sum(F.greatest("listed", F.lit(1))).alias("met"))
    smallest = F.ceil(SIMILARITY * F.col("n") / 100)
    need = F.floor((smallest - F.ceil(SIMILARITY * smallest / 100) + 1) / 2) + 1
    return met.join(classes, "cls").where(F.col("met") >= need).select("cls", "head")


def sets_of(texts: DataFrame) -> DataFrame:
    """(cls, grams): each row's set as packed 64-bit values; classes repeated within a batch come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {class_of(g): g.tobytes() for _, g in gram_sets(batch, 0) if len(g)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(rows.values(), pa.binary())], names=["cls", "grams"])

    return texts.mapInArrow(run, "cls long, grams binary")


def unpacked(rows: DataFrame, keep: list[str], packed: str = "grams") -> DataFrame:
    """One row for each 64-bit value of the packed column, with the ``keep`` columns (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            values = [np.frombuffer(v.as_buffer(), np.int64) for v in column]
            at = np.repeat(np.arange(len(column)), [len(v) for v in values])
            kept = [batch.column(i).take(pa.array(at)) for i in range(len(keep))]
            gram = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(gram, pa.int64())], names=[*keep, "gram"])

    return rows.select(*keep, packed).mapInArrow(run, ", ".join(f"{k} long" for k in [*keep, "gram"]))


def rare_first(postings: DataFrame, within: list[str], carry: list[str]) -> DataFrame:
    """(cls, carried columns, shared): the shingles of each set that others have too, from the rarest on.

    A shingle is told by ``within`` and its value; ``shared`` is an array of structs (df, gram), as long as one text at most.
    """
    key = [*within, "gram"]
    df = postings.groupBy(*key).agg(F.count("*").alias("df")).where("df > 1")
    together = postings.join(df, key).groupBy("cls").agg(*(F.first(c).alias(c) for c in [*within, *carry]), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    return together


def order2_blocks(sets: DataFrame) -> DataFrame:
    """(gram, cls, n, common): the prefixes under order 2; ``common`` is how many of a set's n shingles others have."""
    postings = unpacked(sets.withColumn("n", (F.length("grams") / 8).cast("long")), ["cls", "n"])
    found = rare_first(postings, [], ["n"]).withColumn("common", F.size("shared").cast("long"))
    # What only this set has comes first in its prefix.
    left = (F.col("n") - F.ceil(SIMILARITY * F.col("n") / 100) + 1 - (F.col("n") - F.col("common"))).cast("int")
    alive = found.where(left > 0).select("cls", "n", "common", F.explode(F.slice("shared", 1, left)).alias("s"))
    return alive.select(F.col("s.gram").alias("gram"), "cls", "n", "common")


def homes_of(blocks: DataFrame) -> DataFrame:
    """(cls, n, home): the set that leads most of a set's blocks, then the one that leads its home's, and so on.

    A block is led by the set with the largest share of shingles that others have. Leaders never rank below those they
    lead, so the chains end; each round halves them.
    """
    rank = F.struct(F.col("common") / F.col("n"), F.col("cls"))
    of = blocks.groupBy("gram").agg(F.max_by("cls", rank).alias("leader"), F.max_by("n", rank).alias("leader_n"), F.count("*").alias("size")).where("size > 1")
    alike = 100 * F.least("n", "leader_n") >= SIMILARITY * F.greatest("n", "leader_n")
    led = blocks.join(of, "gram").withColumn("leader", F.when(alike, F.col("leader")).otherwise(F.col("cls")))
    votes = led.groupBy("cls", "leader").agg(F.count("*").alias("votes"), F.first("n").alias("n"))
    homes = checkpointed(votes.groupBy("cls").agg(F.max_by("leader", F.struct("votes", "leader")).alias("home"), F.first("n").alias("n")).select("cls", "n", "home"))
    while True:
        up = homes.select(F.col("cls").alias("home"), F.col("home").alias("next"))
        moved = checkpointed(homes.join(up, "home").select("cls", "n", "home", "next"))
        if not moved.where("home <> next").limit(1).count():
            return homes
        homes = moved.select("cls", "n", F.col("next").alias("home"))


def differences(homes: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, home, excess, size, linked, d): a set's packed difference from its home.

    ``excess`` is (100 + t) |D| - (100 - t) n: sets x, y of one home reach the threshold where 2 (100 + t) |Dx & Dy| is not
    less than the sum of their excesses. A home's own difference is empty and its excess the smallest.
    """
    own = homes.join(sets, "cls").select("cls", "home", F.col("grams").alias("x"))
    sided = own.join(sets.select(F.col("cls").alias("home"), F.col("grams").alias("y")), "home").select("cls", "home", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            excess, size, linked, d = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                g, h = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                away = np.setxor1d(g, h, assume_unique=True)
                size.append(len(away))
                excess.append((100 + SIMILARITY) * len(away) - (100 - SIMILARITY) * len(g))
                linked.append(excess[-1] <= (100 - SIMILARITY) * len(h))
                d.append(away.tobytes())
            made = [pa.array(excess, pa.int64()), pa.array(size, pa.int64()), pa.array(linked, pa.bool_()), pa.array(d, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["cls", "home", "excess", "size", "linked", "d"])

    return sided.mapInArrow(run, "cls long, home long, excess long, size long, linked boolean, d binary")


def met_at_home(apart: DataFrame) -> DataFrame:
    """(block, cls, home, excess, out, common): the prefixes of differences in which a set not linked with its home may meet others."""
    per = apart.where("cls <> home").groupBy("home").agg(F.min("excess").alias("nearest"), F.min(F.when(~F.col("linked"), F.col("excess"))).alias("nearest_out"), F.count("*").alias("members"))
    per = per.where("nearest_out is not null and members > 1")
    seen = apart.where("cls <> home").join(per, "home")
    # An unlinked set may meet any other, a linked one only unlinked ones.
    least = F.ceil((F.col("excess") + F.when(F.col("linked"), F.col("nearest_out")).otherwise(F.col("nearest"))) / (2 * (100 + SIMILARITY)))
    seen = seen.withColumn("prefix", (F.col("size") - F.greatest(least, F.lit(1)) + 1).cast("long")).where("prefix > 0")
    seen = seen.withColumn("out", (~F.col("linked")).cast("long"))
    shared = rare_first(unpacked(seen, ["cls", "home", "excess", "size", "out", "prefix"], "d"), ["home"], ["excess", "size", "out", "prefix"])
    left = (F.col("prefix") - (F.col("size") - F.size("shared"))).cast("int")
    shared = shared.withColumn("common", F.size("shared"))
    met = shared.where(left > 0).select("home", "cls", "excess", "out", "common", F.explode(F.slice("shared", 1, left)).alias("s"))
    return met.select(F.xxhash64("home", "s.gram").alias("block"), "cls", "home", "excess", "out", "common")


def met_abroad(blocks: DataFrame, homes: DataFrame) -> DataFrame:
    """(block, cls, home, n, common): blocks of order 2 that hold sets of different homes."""
    placed = blocks.join(homes.select("cls", "home"), "cls")
    mixed = placed.groupBy("gram").agg(F.min("home").alias("least"), F.max("home").alias("most")).where("least <> most")
    return placed.join(mixed.select("gram"), "gram", "left_semi").select(F.col("gram").alias("block"), "cls", "home", "n", "common")


def pairs_at_home(met: DataFrame) -> DataFrame:
    """Candidates (a, b) of one home and of different parts, at least one of them not linked with the home."""
    x = met.where("out = 1").select("block", F.col("home").alias("h"), F.col("part").alias("xp"), F.col("cls").alias("x"), F.col("excess").alias("xe"), F.col("common").alias("xd"))
    y = met.select("block", "home", F.col("part").alias("yp"), F.col("cls").alias("y"), F.col("excess").alias("ye"), F.col("common").alias("yd"), "out")
    near = (F.col("h") == F.col("home")) & (F.col("xp") != F.col("yp")) & ((F.col("out") == 0) | (F.col("x") < F.col("y"))) & (2 * (100 + SIMILARITY) * F.least("xd", "yd") >= F.col("xe") + F.col("ye"))
    return x.join(y, "block").where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pairs_abroad(met: DataFrame) -> DataFrame:
    """Candidates (a, b) of different homes and parts that meet in a block of order 2."""
    x = met.select("block", F.col("cls").alias("x"), F.col("n").alias("xn"), F.col("common").alias("xc"), F.col("home").alias("xh"), F.col("part").alias("xp"))
    y = met.select("block", F.col("cls").alias("y"), F.col("n").alias("yn"), F.col("common").alias("yc"), F.col("home").alias("yh"), F.col("part").alias("yp"))
    # Both sets' shingles are in the overlap only where others have them too.
    near = (F.col("x") < F.col("y")) & (F.col("xh") != F.col("yh")) & (F.col("xp") != F.col("yp")) & ((100 + SIMILARITY) * F.least("xc", "yc") >= SIMILARITY * (F.col("xn") + F.col("yn")))
    return x.join(y, "block").where(near).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def of_several_parts(met: DataFrame, parts: DataFrame) -> DataFrame:
    """The blocks' rows with their part (the set itself where it has no links), without blocks of one part."""
    placed = met.join(parts, F.col("cls") == F.col("node"), "left").withColumn("part", F.coalesce("component", "cls")).drop("node", "component")
    several = placed.groupBy("block").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
    return placed.join(several.select("block"), "block", "left_semi")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Parts (node, component) after more links: a part takes the least name within two links.

    Parts of one name are linked; what is further apart stays apart, which makes more pairs, never fewer.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    parts = parts.join(nodes, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("a_part <> b_part").select(F.col("a_part").alias("x"), F.col("b_part").alias("y"))
    edges = edges.union(edges.select("y", "x")).distinct()
    near = edges.groupBy("x").agg(F.least("x", F.min("y")).alias("near"))
    far = edges.join(near.select(F.col("x").alias("y"), F.col("near").alias("far")), "y").groupBy("x").agg(F.min("far").alias("far"))
    named = near.join(far, "x").select("x", F.least("near", "far").alias("name"))
    return checkpointed(parts.join(named, F.col("component") == F.col("x"), "left").select("node", F.coalesce("name", "component").alias("component")))


def led_links(met: DataFrame, stars: DataFrame, sets: DataFrame, counts: dict | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(more links, parts): in each round, each set against the leader of most of its blocks; one row a set and round.

    Leaders are drawn anew by a hash in each round. Rounds end when one finds no link, or after LEADER_ROUNDS; what
    they leave is for the pairs of different parts.
    """
    parts = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
    more, held = None, 0
    for k in range(LEADER_ROUNDS):
        placed = of_several_parts(met.select("block", "cls"), parts)
        leaders = placed.groupBy("block").agg(F.max_by(F.struct("cls", "part"), F.xxhash64(F.lit(k), "cls")).alias("leader"))
        led = placed.join(leaders, "block").where(F.col("part") != F.col("leader.part")).select("cls", F.col("leader.cls").alias("leader"))
        votes = led.groupBy("cls", "leader").agg(F.count("*").alias("votes"))
        pairs = votes.groupBy("cls").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"))
        pairs = checkpointed(pairs.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct())
        found = checkpointed(verified(pairs, sets))
        if counts is not None:
            held += pairs.count()
        if not found.limit(1).count():
            break
        more = found if more is None else more.union(found)
        parts = merged(parts, found)
    if counts is not None:
        counts["led"] = held
    return more, parts


def with_both(candidates: DataFrame, of: DataFrame, *packed: str) -> DataFrame:
    """The candidates with the packed columns of a and then of b."""
    left = of.select(F.col("cls").alias("a"), *(F.col(c).alias(f"{c}_a") for c in packed))
    right = of.select(F.col("cls").alias("b"), *(F.col(c).alias(f"{c}_b") for c in packed))
    return candidates.join(left, "a").join(right, "b").select("a", "b", *(f"{c}_{s}" for s in "ab" for c in packed))


def share_prefixes(candidates: DataFrame, sets: DataFrame, orders: Orders) -> DataFrame:
    """The candidates (a, b) that have a common prefix shingle under each of orders 1, 3 and 4.

    Prefixes are compared by 32 bits of the hashes, so a few pairs too many may stay.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.unique(orders.prefix(np.frombuffer(v.as_buffer(), np.uint64), k).astype(np.uint32)).tobytes() for v in batch.column(1)] for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.binary()) for s in sides)], names=["cls", "p1", "p3", "p4"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for k in range(3):
                for i, (x, y) in enumerate(zip(batch.column(2 + k), batch.column(5 + k), strict=True)):
                    if stay[i]:
                        stay[i] = common_size(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) > 0
            at = pa.array(np.flatnonzero(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    packed = sets.mapInArrow(sketch, "cls long, p1 binary, p3 binary, p4 binary")
    return with_both(candidates, packed, "p1", "p3", "p4").mapInArrow(test, "a long, b long")


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """The number of values in both of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) else 0


def verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                g, h = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = common_size(g, h)
                if 100 * both >= SIMILARITY * (len(g) + len(h) - both):
                    links.append(i)
            at = pa.array(links, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return with_both(candidates, sets, "grams").mapInArrow(run, "a long, b long")


def links_between(texts: DataFrame, orders: Orders, classes: DataFrame, counts: dict | None = None) -> DataFrame:
    """Links (a, b) of classes whose components are those of all links. ``counts`` takes the rows after each filter."""
    passed = checkpointed(may_have_links(texts.select("text"), orders, classes))
    ids = passed.where("head is not null").select(F.col("head").alias("id"))
    own = texts.join(broadcast_if_small(ids, ids.count()), "id", "left_semi").select("text").union(texts.where("id is null").select("text"))
    sets = checkpointed(sets_of(own).groupBy("cls").agg(F.first("grams").alias("grams")).join(passed.select("cls"), "cls", "left_semi"))
    blocks = checkpointed(order2_blocks(sets))
    homes = homes_of(blocks)
    apart = checkpointed(differences(homes, sets.join(homes.select("cls"), "cls", "left_semi")))
    stars = apart.where("linked and cls <> home").select(F.col("cls").alias("a"), F.col("home").alias("b"))
    home, abroad = checkpointed(met_at_home(apart)), checkpointed(met_abroad(blocks, homes))
    more, parts = led_links(home.select("block", "cls").union(abroad.select("block", "cls")), stars, sets, counts)
    candidates = checkpointed(pairs_at_home(of_several_parts(home, parts)).union(pairs_abroad(of_several_parts(abroad, parts))))
    pairs = checkpointed(share_prefixes(candidates, sets, orders))
    found = checkpointed(verified(pairs, sets))
    if counts is not None:
        counts |= {"passed": passed.count(), "blocks": blocks.count(), "homes": homes.count(), "candidates": candidates.count(), "pairs": pairs.count(), "found": found.count()}
    found = stars.union(found)
    return found if more is None else found.union(more)


def grouped(docs: DataFrame, id_col: str, text_col: str, counts: dict | None = None) -> DataFrame:
    """(id, row, n, component) of every row: a hash of its text, its set's size and its component's class (null: no words)."""
    text = F.col(quoted(text_col)).cast("string")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    first = checkpointed(sizes_and_common(texts))
    orders = common_orders(first.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")))
    members = first.where("n is not null").select("id", "row", "n", "cls")
    classes = members.where("cls is not null").groupBy("cls").agg(F.min("id").alias("head"), F.first("n").alias("n"))
    part = connected_components(links_between(texts, orders, classes, counts))
    part = part.select(F.col("node").alias("cls"), "component")
    return members.join(part, "cls", "left").select("id", "row", "n", F.coalesce("component", "cls").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: dict | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row: its set's size and the smallest id reachable by links."""
    members = grouped(docs, id_col, text_col, counts)
    smallest = members.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    found = members.join(smallest, "component", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each group by id (null last) and a hash of the text; all columns stay.

    Rows without words are in no group and stay. Of rows with one id and one text, any one stays.
    """
    members = grouped(docs, id_col, text_col).where("component is not null")
    best = F.struct(F.col("id").isNull(), "id", "row")
    kept = members.groupBy("component").agg(F.min(best).alias("best"), F.count("*").alias("size")).select("best.id", "best.row", "size")
    kept = checkpointed(kept.groupBy("id", "row").agg(F.max("size").alias("size")))
    row, kept_id, kept_row, size = (free_name(docs, c) for c in ("row", "kept_id", "kept_row", "size"))
    columns = [F.col(quoted(c)) for c in docs.columns]
    keyed = docs.select("*", F.xxhash64(F.col(quoted(text_col)).cast("string")).alias(row))
    named = kept.select(F.col("id").alias(kept_id), F.col("row").alias(kept_row), F.col("size").alias(size))
    found = keyed.join(named, F.col(quoted(id_col)).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(row) == F.col(kept_row)))
    single = found.where(F.col(size) == 1).select(*columns)
    several = found.where(F.col(size) > 1).dropDuplicates([kept_id, row]).select(*columns)
    wordless = docs.where(~F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return single.union(several).union(wordless.select(*columns))
