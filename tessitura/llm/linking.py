"""Links within buckets, without all pairs: stars, an inverted index of rare members, components.

Candidate search puts ids into buckets.  Testing every pair of a bucket is quadratic,
and needless where only components are asked for:

1. *Stars*: each bucket's smallest id is tested against the others.
2. *Components* of the links found (alternating large-star and small-star).
3. *The rest*: a bucket of up to ``OUTER`` ids that still holds several components is
   compared inside one task, where no pair leaves but a link.  Of buckets with equal
   lists of ids, one is.
4. *More stars*: larger buckets are tested around another pivot, drawn by a hash,
   between components only.
5. *Rare members*: what is still apart in them goes to new buckets.  Order the members of
   every set by how common they are; two sets with a Jaccard similarity of at least t
   share one of the first n - ceil(t * n) + 1 of either (prefix filter), so each id goes
   to the buckets of its own rarest members.  Unlike ids share common members only, and
   meet nowhere: the work follows the number of ids, not of pairs.  Then step 3 in these
   buckets; those beyond ``OUTER`` are compared in blocks of that size.

A pair that shares a bucket is thus tested or already connected, so the components are
those of testing all pairs.  Step 5's blocks are the only work that can grow faster than
the input, and only with very many ids that share a rare member without being linked.

Hot buckets are split: the most frequent keys are found on a sample of the ids (a choice
of plan, nothing is left out), their rows stay where they are and meet a short broadcast
table.  Components and links never reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import discard, lean, mix, written

BITMAP_BITS = 24
#: rounds of drawn pivots; sides of a block: members outside the main component, which are held, and of all, which stream past
TURNS, OUTER, INNER = 1, 256, 8192
#: at most HOT keys, of HOT_ROWS rows or more by a sample of one id in ONE_IN, are split
HOT, HOT_ROWS, ONE_IN = 1000, 1024, 64
#: edges that one task may join
TASK_EDGES = 2**20
#: a pivot with many partners is sent to this many places
SALTS, ORDER_BITS = 32, 18
#: rows of a table that whole texts meet by a broadcast (some 30 MB); beyond that, texts that may be concerned are dealt out
FEW = 2**18


def as_hashes(per_cent: int) -> Callable[[memoryview], tuple[np.ndarray, int]]:
    return lambda raw: (np.frombuffer(raw, np.uint64), per_cent)


def forest(batches):
    """One edge (u, v: the smallest id that this task's edges connect it with) for each id of a task's edges that is not the smallest."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, both = np.unique(np.concatenate((u, v)), return_inverse=True)
        u, v = both[: len(u)], both[len(u) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while (root[root] != root).any():
                root = root[root]
            if (before == root).all():
                break
        hang = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[hang]), pa.array(ids[root[hang]])], ["u", "v"])


def components(edges: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """id and component (the smallest id reachable) for every id in ``edges`` (a, b); its table is added to ``scratch``.

    A distributed union-find: each task joins what its own edges connect and passes on a
    forest of stars, large-star and small-star merge the forests, until all are stars or
    ``TASK_EDGES`` edges are left, 16 MB, which one task joins.
    """
    state, before = edges.select(F.col("a").alias("u"), F.col("b").alias("v")), None
    while True:
        state = written(state.mapInArrow(lean(forest), "u long, v long"), "edges")
        if before is not None:
            discard(before)
        if state.count() <= TASK_EDGES:  # the forests fit into a task, which ends the search
            before, state = state, written(state.coalesce(1).mapInArrow(lean(forest), "u long, v long"), "edges")
            discard(before)
            break
        # done when all are stars: each id hangs once, and no centre hangs
        ends = state.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(state.select(F.col("v").alias("x"), F.lit(0).alias("n")))
        left = ends.groupBy("x").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("k")).where("n > 1 OR n = 1 AND k > 0")
        if left.isEmpty():
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, state = state, hang.unionByName(low.select("u", F.col("m").alias("v")))
    scratch.append(state)
    roots = state.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


# hot keys ------------------------------------------------------------------
def sampled(rows: DataFrame, by: str = "id") -> DataFrame:
    """The rows of one ``by`` in ``ONE_IN``."""
    return rows.where(f"pmod(xxhash64({by}), {ONE_IN}) = 0")


def frequent(sample: DataFrame, column: str = "key") -> list[int]:
    """The most frequent values of ``column``, at most ``HOT``; ``sample``: the rows of one id in ``ONE_IN``."""
    n = sample.groupBy(column).count()
    return [r[0] for r in n.where(f"count * {ONE_IN} >= {HOT_ROWS}").orderBy(F.desc("count"), column).limit(HOT).collect()]


def joined(rows: DataFrame, few: DataFrame, on: list[str], hot: list[int], column: str = "key") -> DataFrame:
    """``rows`` joined with ``few`` (one row for each key): rows of hot keys stay in place and meet a broadcast of at most ``HOT`` rows."""
    if not hot:
        return rows.join(few, on)
    there = F.col(column).isin(hot)
    return rows.where(~there).join(few.where(~there), on).unionByName(rows.where(there).join(F.broadcast(few.where(there)), on))


def company(hot: list[int]) -> Callable:
    """key, id, pivot (the smallest id) of the keys that have more than one id, and of all hot ones; rows (key, id) come by key."""
    always = np.array(hot, np.int64)

    def some(k, i):
        near = k[1:] == k[:-1]
        use = (np.append(False, near) | np.append(near, False))[: len(k)] | np.isin(k, always)
        k, i = k[use], i[use]
        order = np.lexsort((i, k))
        k, i = k[order], i[order]
        new = np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]))[: len(k)]
        k, i = k[new], i[new]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
        sizes = np.diff(np.append(starts, len(k)))
        many = np.repeat(sizes > 1, sizes) | np.isin(k, always)
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (k, i, np.repeat(i[starts], sizes))], ["key", "id", "pivot"])

    def run(batches):
        last, held, size = 0, [], 0  # the last key, its ids so far; repeated ones go when there are many
        for b in batches:
            if not b.num_rows:
                continue
            k, i = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if held and cut == 0 and k[0] == last:
                held.append(i.copy())
                size += len(i)
                if size > 2**20:
                    held, size = [np.unique(np.concatenate(held))], 0
                continue
            before = np.concatenate(held) if held else i[:0]
            yield some(np.concatenate((np.full(len(before), last, np.int64), k[:cut])), np.concatenate((before, i[:cut])))
            last, held, size = k[-1], [i[cut:].copy()], len(i) - cut
        if held:
            ids = np.concatenate(held)
            yield some(np.full(len(ids), last, np.int64), ids)

    return run


def packed(keys: np.ndarray, ids: np.ndarray, parts: int, hot: list[int]) -> pa.RecordBatch:
    """part, keys, ids: a row for each part, of all its keys and their ids as bytes, two thirds of what they take as rows.

    A key has one part, but for the hot ones, which have up to ``SALTS``.
    """
    part = (mix(keys.view(np.uint64)) >> np.uint64(8)) % np.uint64(parts)
    there = np.isin(keys, np.array(hot, np.int64)) if hot else np.zeros(len(keys), bool)
    part[there] = (part[there] + mix(ids[there].view(np.uint64)) % np.uint64(SALTS)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part, keys, ids = part[order], keys[order], ids[order]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    spans = list(zip(cut.tolist(), np.append(cut[1:], len(part)).tolist(), strict=True)) if len(part) else []
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (keys, ids))], ["part", "keys", "ids"])


def unpacked(batches):
    """key and id of the rows that ``packed`` made."""
    for b in batches:
        for i in range(0, b.num_rows, 16):
            keys, ids = (np.frombuffer(b"".join(b.column(c).slice(i, 16).to_pylist()), np.int64) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "id"])


def crowded(rows: DataFrame | Callable[[int, list[int]], DataFrame], hot: list[int], kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """key, id, pivot (the smallest id) of the buckets that hold more than one id; rows (key, id) may be repeated.

    Most keys have one id and end here: after one exchange a task sorts its rows by key (Spark's
    sort, which can spill) and streams them, holding the ids of one key at a time.  Hot keys are
    dealt to ``SALTS`` places, and their pivots are put together after that.  ``rows`` is read once.
    It may be a function of a number of parts and the hot keys that gives what ``packed`` makes.
    """
    if callable(rows):
        parts = 8 * int(SparkSession.active().conf.get("spark.sql.shuffle.partitions"))
        dealt = rows(parts, hot).repartition("part").mapInArrow(lean(unpacked), "key long, id long")
    else:
        dealt = _salted(rows, hot)
    out = kept(dealt.sortWithinPartitions("key").mapInArrow(lean(company(hot)), "key long, id long, pivot long"), "buckets")
    if not hot:
        return out
    there = F.col("key").isin(hot)
    heads = out.where(there).groupBy("key").agg(F.min("pivot").alias("pivot"), F.max("id").alias("top")).where("pivot < top").select("key", "pivot").collect()  # at most HOT rows
    many = out.where(F.col("key").isin([k for k, _ in heads])).mapInArrow(headed(dict(map(tuple, heads))), "key long, id long, pivot long")
    return out.where(~there).unionByName(kept(many, "hot"))  # written, as they are read several times


def headed(heads: dict[int, int]) -> Callable:
    """Rows (key, id, pivot) with the pivots of ``heads``, which has all their keys."""
    keys = np.array(sorted(heads), np.int64)
    pivots = np.array([heads[k] for k in keys.tolist()], np.int64)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivots[np.searchsorted(keys, b.column(0).to_numpy())])], ["key", "id", "pivot"])

    return run


def _salted(rows: DataFrame, hot: list[int]) -> DataFrame:
    salt = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    dealt = rows.select("key", "id", salt.cast("int").alias("salt")).repartition("key", "salt") if hot else rows.select("key", "id").repartition("key")
    return dealt.select("key", "id")


# search --------------------------------------------------------------------
def link(rows: DataFrame | Callable[[int, list[int]], DataFrame], fetch: Callable[[DataFrame], DataFrame], unpack: Callable[[memoryview], tuple[np.ndarray, int]], screen: Callable[[DataFrame], DataFrame] | None = None, scratch: list[DataFrame] | None = None, sample: DataFrame | None = None) -> DataFrame:
    """id and component of all ids that are linked to another.

    ``rows``: (key, id), any number of times, or a function that ``crowded`` takes, which needs a ``sample``.  ``fetch`` takes ids (id) and returns their
    sets (id, set: a binary that ``unpack`` turns into sorted distinct 64-bit hashes and
    the per cent of the union that they must share with another set).
    ``screen`` may drop pairs (a, b) that can't be linked before their sets are compared.
    Tables that the result still reads are added to ``scratch``, for the caller to discard.
    ``sample``: the rows of one id in ``ONE_IN``, where they come cheaper than by a filter on ``rows``.
    """
    search = _Search(screen, unpack)
    try:
        hot = frequent(sampled(rows) if sample is None else sample)
        crowd = crowded(rows, hot, search.kept)
        search.sets = search.kept(fetch(crowd.select("id").distinct()), "sets")
        search.stars(crowd)
        large = search.settle(crowd, hot, OUTER)
        if large is not None:
            search.drawn(large, hot, TURNS)
            apart = search.kept(_mixed(large, search.found, hot).select("id", "component").distinct(), "apart")
            if not apart.isEmpty():
                rare = search.kept(_rare(apart, search.sets, unpack), "rare")
                hot = frequent(sampled(rare))
                search.settle(crowded(rare, hot, search.kept), hot, None)
        if scratch is not None:
            scratch.extend(search.last)
        return search.found
    finally:
        discard(*search.scratch)


class _Search:
    """Pairs tested, links and components found so far."""

    def __init__(self, screen, unpack):
        self.screen, self.unpack = screen, unpack
        self.scratch: list[DataFrame] = []
        self.last: list[DataFrame] = []
        self.sets = self.tested = self.links = self.found = None

    def kept(self, df: DataFrame, what: str) -> DataFrame:
        self.scratch.append(written(df, what))
        return self.scratch[-1]

    def test(self, pairs: DataFrame) -> None:
        """Test pairs (a: pivot, b) that were not tested before."""
        pairs = pairs.distinct()
        if self.tested is not None:
            ends = lambda df: df.select("*", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            pairs = ends(pairs).join(ends(self.tested).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti").select("a", "b")
        pairs = self.kept(pairs, "stars")
        if self.tested is not None and pairs.isEmpty():
            return  # these were tested already; other pairs may not be
        near = self.kept(self.screen(pairs), "pairs") if self.screen else pairs
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        self.add(verified(near, self.sets, self.unpack))

    def add(self, links: DataFrame) -> None:
        links = self.kept(links, "links")
        first = self.links is None
        if not first and links.isEmpty():
            return
        # on top of what is connected already: one edge for each id
        edges = links if first else links.unionByName(self.found.select(F.col("component").alias("a"), F.col("id").alias("b")).where("a != b"))
        self.links = links
        old, self.last = self.last, []
        self.found = components(edges, self.last)
        discard(*old)

    def stars(self, crowd: DataFrame) -> None:
        self.test(crowd.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))

    def drawn(self, crowd: DataFrame, hot: list[int], turns: int) -> None:
        """Another pivot for each bucket, drawn by a hash, against the members of other components."""
        for turn in range(turns):
            named = self.kept(_named(crowd, self.found), "named")
            # by the id alone: buckets of equal lists draw the same pivot, and their pairs are the same
            draw = named.groupBy("key").agg(F.max(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "component")).alias("p")).select("key", F.col("p.id").alias("p"), F.col("p.component").alias("cp"))
            self.test(joined(named, draw, ["key"], hot).where("component != cp").select(F.col("p").alias("a"), F.col("id").alias("b")))

    def settle(self, crowd: DataFrame, hot: list[int], most: int | None) -> DataFrame | None:
        """Compare what is still apart in buckets of up to ``most`` ids; the rows (key, id) of larger ones."""
        mixed = self.kept(_mixed(crowd, self.found, hot), "mixed")
        if mixed.isEmpty():
            return None
        small = mixed if most is None else mixed.where(f"n <= {most}")
        sizes = small.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids"))
        lists = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("ids").alias("ids"))
        lists = lists.groupBy("n", "ids").agg(F.min(F.struct("key", "main", "most")).alias("x")).select("n", "x.key", "x.main", "x.most")
        some = lists.select("key", "main", F.ceil((F.col("n") - F.col("most")) / OUTER).cast("int").alias("outer"), F.ceil(F.col("n") / INNER).cast("int").alias("inner"))
        some = self.kept(some, "lists")
        self.add(_blocks(joined(small.drop("n"), some, ["key"], hot), self.sets, self.unpack))
        if most is None or mixed.where(f"n > {most}").isEmpty():
            return None
        return mixed.where(f"n > {most}").select("key", "id")


def _named(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, id, component)."""
    return crowd.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))


def _mixed(crowd: DataFrame, found: DataFrame, hot: list[int]) -> DataFrame:
    """Rows (key, id, component, n: the bucket's rows) of the buckets that hold more than one component."""
    named = _named(crowd, found)
    if not hot:
        named = named.repartition("key")  # one exchange serves the counts and the join
    mixed = named.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n")).where("c != d").select("key", "n")
    return joined(named, mixed, ["key"], hot)


def prefix_length(n: int, per_cent: int) -> int:
    """Of two sets that are linked, either shares one of its first so many members with the other's."""
    return n - -(-per_cent * n // 100) + 1


def _rare(apart: DataFrame, sets: DataFrame, unpack: Callable[[memoryview], tuple[np.ndarray, int]]) -> DataFrame:
    """key (a member of the set) and id: the rarest members of each id of ``apart``, where they tell components apart."""
    some = sets.join(apart, "id")
    slots = 2**ORDER_BITS
    low = np.uint64(slots - 1)

    def counted(batches):
        total = np.zeros(slots, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                members = [unpack(raw.as_buffer())[0] for raw in b.column(0).slice(i, 1000)]
                total += np.bincount((mix(np.concatenate(members)) & low).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    got = some.select("set").mapInArrow(lean(counted), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** ORDER_BITS rows
    common = np.zeros(slots, np.uint64)
    common[got.column("slot").to_numpy()] = got.column("n").to_numpy().astype(np.uint64)

    def prefixes(batches):
        for b in batches:
            keys, sizes = [], []
            for raw in b.column(2):
                members, per_cent = unpack(raw.as_buffer())
                members = mix(members)
                order = np.lexsort((members, common[(members & low).astype(np.int64)]))
                keys.append(members[order[: prefix_length(len(members), per_cent)]])
                sizes.append(len(keys[-1]))
            if keys:
                again = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(again), b.column(1).take(again)], ["key", "id", "component"])

    rows = written(some.select("id", "component", "set").mapInArrow(lean(prefixes), "key long, id long, component long"), "prefixes")
    lists = rows.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids"))
    lists = lists.where("c != d").groupBy("n", "ids").agg(F.min("key").alias("key")).select("key")  # of equal lists one is enough
    out = joined(rows.select("key", "id"), lists, ["key"], frequent(sampled(rows)))
    out = written(out, "rare")
    discard(rows)
    return out


def _blocks(member: DataFrame, sets: DataFrame, unpack: Callable[[memoryview], tuple[np.ndarray, int]]) -> DataFrame:
    """Links (a, b) between components: at least one for each two that share a bucket and are linked.

    ``member``: key, id, component, main (the bucket's main component) and how many blocks of
    outer and of inner members the bucket has.  The members outside the main component are
    compared with all members, block by block, inside the tasks: no pair leaves a task but
    one link for each member and component.
    """
    h = F.abs(F.xxhash64("id") % (1 << 40))
    # a bucket of one cell has every member once: role 0 (held) or 1; others have those outside the main component twice
    whole = (F.col("outer") == 1) & (F.col("inner") == 1)
    every = F.explode(F.expr("sequence(0, other - 1)")).alias("o")
    cell = ["key", "x", "y", "alone", "role", "id", "component"]
    own = member.withColumn("alone", whole)
    left = own.where("component != main").withColumns({"x": h % F.col("outer"), "other": F.col("inner")}).select("key", F.lit(0).alias("role"), "id", "component", "x", "alone", every).withColumn("y", F.col("o").cast("long")).select(cell)
    right = own.where("NOT alone OR component = main").withColumns({"y": h % F.col("inner"), "other": F.col("outer")}).select("key", F.lit(1).alias("role"), "id", "component", "y", "alone", every).withColumn("x", F.col("o").cast("long")).select(cell)

    def run(batches):
        at, outer = None, _Outer()
        for b in batches:
            out = []
            for *cell, alone, role, name, component, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cell != at:
                    out += outer.among()
                    at, outer = cell, _Outer()
                members, per_cent = unpack(raw)
                if role == 0:
                    outer.add(name, component, members, per_cent, alone)
                else:
                    out += outer.compare(name, component, members, per_cent)
            yield _pairs(out)
        yield _pairs(outer.among())

    dealt = left.unionByName(right).join(sets, "id").select(*cell, "set").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "role")
    return dealt.mapInArrow(lean(run), "a long, b long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Outer:
    """The outer members of a cell of a bucket (at most some ``OUTER``); the inner ones stream past."""

    def __init__(self):
        self.names, self.components, self.sets, self.done, self.sorted = [], [], [], set(), None
        self.alone, self.per_cent = False, []

    def add(self, name: int, component: int, members: np.ndarray, per_cent: int, alone: bool) -> None:
        self.alone = alone
        self.per_cent.append(per_cent)
        self.names.append(name)
        self.components.append(component)
        self.sets.append(members)

    def among(self) -> list[tuple[int, int]]:
        """Links among the outer members, where they meet in no other role."""
        return [link for c in zip(self.names, self.components, self.sets, self.per_cent, strict=True) for link in self.compare(*c)] if self.alone else []

    def compare(self, name: int, component: int, x: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
        """One link for each outer member and other component."""
        if not self.sets:
            return []
        if self.sorted is None:
            owner, hashes = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets]), np.concatenate(self.sets)
            order = np.argsort(hashes, kind="stable")
            self.sorted = owner[order], hashes[order], np.array([len(s) for s in self.sets]), np.array(self.components)
        owner, hashes, sizes, own = self.sorted
        lo, hi = np.searchsorted(hashes, x), np.searchsorted(hashes, x, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(sizes))
        out = []
        for i in np.flatnonzero((100 * same >= per_cent * (sizes + len(x) - same)) & (own != component)).tolist():
            if (i, component) not in self.done:
                self.done.add((i, component))
                out.append((min(self.names[i], name), max(self.names[i], name)))
        return out


def bitmap(ids: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """``2 ** bits`` flags (bytes of 8): where an id of ``ids`` has its low bits.

    The size is fixed, so it may be broadcast: it lets scans skip most rows that no
    pair needs.  On very large inputs it fills up and lets more rows through.
    """
    low = ids.select(F.expr(f"{column} & {2**bits - 1}").alias("p"))
    got = low.groupBy(F.expr("shiftright(p, 15)").alias("n")).agg(F.bitmap_construct_agg(F.expr("p & 32767")).alias("bits")).collect()
    out = np.zeros(2 ** (bits - 3), np.uint8)
    for n, b in got:
        out[n * 4096 : n * 4096 + 4096] = np.frombuffer(bytes(b), np.uint8)
    return out


def flagged(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids.astype(np.int64) & (len(flags) * 8 - 1)
    return (flags[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def apart(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``column`` (a long) may be one of ``ids`` (of one column), and those where it is none of them.

    ``rows`` is read twice, and only the first need meet what belongs to the ids: the others take part in no exchange.
    Flags are 16 bits an id, 16 MB at most, which is broadcast; beyond some 2 ** 23 ids more of the first are in vain.
    """
    bits = min(27, max(20, int(16 * ids.count()).bit_length()))
    low = ids.select((F.col(ids.columns[0]).bitwiseAND(F.lit(2**bits - 1))).alias("p"))
    flags = written(low.groupBy(F.expr("shiftright(p, 15)").alias("_block")).agg(F.bitmap_construct_agg(F.expr("p & 32767")).alias("_bits")), "flags")
    place = f"({column} & {2**bits - 1})"
    there = F.expr(f"coalesce(getbit(cast(conv(hex(substring(_bits, cast(({place} & 32767) DIV 8 AS int) + 1, 1)), 16, 10) AS long), cast({place} & 7 AS int)) = 1, false)")
    met = rows.join(F.broadcast(flags), F.expr(f"shiftright({place}, 15)") == F.col("_block"), "left").withColumn("_there", there)
    return tuple(met.where(x).drop("_block", "_bits", "_there") for x in ("_there", "NOT _there"))


def alike(p: np.ndarray, q: np.ndarray, per_cent: int) -> bool:
    """100 * intersection >= per_cent * union, of sorted distinct hashes."""
    if 100 * min(len(p), len(q)) < per_cent * max(len(p), len(q)):
        return False
    both = np.concatenate((p, q))
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= per_cent * (len(both) - same)


def verified(pairs: DataFrame, sets: DataFrame, unpack: Callable[[memoryview], tuple[np.ndarray, int]]) -> DataFrame:
    """The pairs (a: pivot, b) whose sets have 100 * intersection >= per_cent * union.

    ``sets``: id and a binary that ``unpack`` turns into sorted distinct 64-bit hashes and the per cent.  The
    pivot's set comes once for all its partners, or up to ``SALTS`` times if it has many.
    """

    def run(batches):
        at, pivot = None, None
        for x in batches:
            a, s, b, raw = x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3)
            out = []
            for i, name in enumerate(zip(a, s, strict=True)):
                members, per_cent = unpack(raw[i].as_buffer())
                if b[i] is None:
                    at, pivot = name, members.copy()
                elif name == at and alike(pivot, members, per_cent):
                    out.append((a[i], b[i]))
            yield _pairs(out)

    salted = pairs.select("a", F.expr(f"pmod(xxhash64(b), {SALTS})").cast("int").alias("s"), "b")
    partners = salted.join(sets.withColumnRenamed("id", "b"), "b").select("a", "s", "b", "set")
    pivots = salted.select("a", "s").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "s", F.lit(None).cast("long").alias("b"), "set")
    dealt = pivots.unionByName(partners).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(lean(run), "a long, b long")
