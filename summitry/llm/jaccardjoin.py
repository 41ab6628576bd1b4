"""Exact Jaccard join of word-shingle sets with PartEnum signatures.

Two sets of similarity 0.8 or more differ in few elements, at most ``difference(n)``
of them for a set of n and any partner.  Sets of one size band [2^b, 2^(b+1)) share
a cut of the feature domain into n1 parts of n2 = 2 pieces, of which k2 = 1 may
differ, so the enumerated subsets of n2 - k2 pieces are the single pieces; the hash
of a piece's content is a signature.  Sets that may have partners in the next band
sign under that one as well.

An element in which two sets differ spoils one piece at most.  So a set with d
filled pieces shares at least ``need`` = d - difference(n) signatures with any
partner, and one whose signatures are shared fewer times with all others together
has no partner.  A set whose elements crowd into too few pieces goes on to further
cuts, in the end to its band alone (see ``sign``), so no pair is lost.

The steps of ``link_components``:

1. Sets get 64-bit names (digests); exact copies are one set from here on.
2. Signatures are counted, and sets without enough shared ones leave.  A batch
   sends a signature once, so a signature of all sets is no hot key.
3. Each set that stays votes for a leader, the most central set of most of its
   signatures, and is compared with it; what links with one leader is joined.
4. Sets that share enough signatures with sets that other leaders have joined are
   compared within their leader's group: those that aren't joined as most of the
   group are with all, in cells of bounded size.  New leaders are chosen among what
   is still open.
5. After ``ROUNDS`` rounds the sets that are open still meet at each signature but
   the ``need`` - 1 most frequent ones, again in cells of bounded size.

Pairs are never emitted; a cell returns links that join components it has not yet
joined.  A pair is left uncompared only if a chain of links already joins it.

Edge cases: null and empty texts have no shingles and no links; fewer than five
words make one shingle; texts of any length are used whole; rows with a null id are
returned with a null component and link nothing; rows that repeat an id are one
document, joined to whatever any of its texts links to, and each has its own size;
equal sets need no signature; an empty table gives no rows; other columns play no
part.  Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops, common
from .bytesops import mix
from .components import components

#: Jaccard similarity of 80 / 100 and more links.
PERCENT = 80
#: Cuts of the domain that a set with crowded pieces goes through.
SEEDS = 4
#: Rounds of leaders before sets meet by signature.
ROUNDS = 2
#: Members that are compared with one copy of a leader.
GROUP = 500
#: Shingles in one side of a cell, apart from a set's own size.
CELL = 1 << 18
#: Doublings of the pointers to leaders.
HOPS = 2
#: Of so many signatures one votes for the first leaders.
VOTING = 4


def difference(n: int) -> int:
    """The largest symmetric difference of a set of n with a partner of any allowed size."""
    return (n + 100 * n // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def cut_of(band: int) -> tuple[int, int]:
    """n1 parts of n2 pieces for the sets of a band: more pieces than may differ, with slack."""
    most = difference((2 << band) - 1)
    pieces = most + 1 + max(3, 15 * most // 100)
    return -(-pieces // 2), 2


CUTS = [cut_of(b) for b in range(31)]


def bands_of(n: int) -> list[int]:
    """The set's own band, and the next one if a partner may be there."""
    band = n.bit_length() - 1
    return [band, band + 1] if 100 * n // PERCENT >= 2 << band else [band]


def sign(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set of uniform 64-bit hashes, and the need of each one's cut.

    The low byte of a signature names its band and cut.  Where all filled pieces may
    differ (need 0) a set goes on to the next cut.  Two sets both go through every cut
    up to the first at which one of them has a need, and that one's need covers the
    pair; sets without a need in any cut of a band sign under the band alone.
    """
    found, needs = [], []
    n = len(u)
    most = difference(n)
    if not most:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    hashed = mix(u + np.uint64(0x632BE59BD9B4E019))
    for band in bands_of(n):
        n1, n2 = CUTS[band]
        for seed in range(SEEDS):
            tag = np.uint64(band * 8 + seed)
            m, content = u, hashed
            if seed:
                m = np.sort(mix(u ^ np.uint64(0x9E3779B97F4A7C15 * seed % (1 << 64))))
                content = mix(m + np.uint64(0x632BE59BD9B4E019))
            piece = (m >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)
            start = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            key = mix(piece[start] * np.uint64(256) + tag)
            found.append((mix(np.add.reduceat(content, start) + key) & ~np.uint64(255)) | tag)
            needs.append(np.full(len(start), max(0, len(start) - most), np.int32))
            if len(start) > most:
                break
        else:
            tag = np.uint64(band * 8 + SEEDS)
            found.append((mix(np.array([band + 1], np.uint64)) & ~np.uint64(255)) | tag)
            needs.append(np.zeros(1, np.int32))
    return np.concatenate(found), np.concatenate(needs)


def shingle_sets(texts: list[bytes]):
    """(place, sorted set of shingle hashes) of each text, block by block."""
    for a, b in bytesops.blocks(texts):
        words = bytesops.Words(texts[a:b])
        for i in range(b - a):
            u = np.sort(bytesops.shingle_hashes(words.hash[words.first[i] : words.first[i + 1]]))
            yield a + i, u[np.concatenate(([True], u[1:] != u[:-1]))] if len(u) else u


def name_of(u: np.ndarray) -> int:
    """64 bits of a set's content, signed."""
    return int(mix(np.array([mix(u).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)).astype(np.int64)[0])


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.split())


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key): size and name of every row's set; key is null for empty ones."""

    def run(batches):
        for b in batches:
            texts = bytesops.texts_of(b.column("text"))
            n, key = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, u in shingle_sets(texts):
                n[i], key[i] = len(u), name_of(u)
            yield _batch("doc_id n key", b.column("doc_id"), n, pa.array(key, mask=n == 0))

    return common.in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, key long", "jaccard")


#: Marks the row that tells of a set's signatures which its own batch has seen twice.
TOLD = 255


def signature_rows(docs: DataFrame) -> DataFrame:
    """(sig, key, told): what other batches need to know about the signatures of each batch.

    A signature of one set in the batch is a row; one of several sets is a row with a
    null key, for it is known to be shared.  How many such ones a set has under a cut,
    and the cut's need, is packed in ``told`` of a row of its own.
    """

    def rows(found: list[tuple]):
        keys = np.array([k for k, _, _ in found], np.int64)
        lengths = [len(s) for _, s, _ in found]
        sig, need = np.concatenate([s for _, s, _ in found]), np.concatenate([x for _, _, x in found])
        owner = np.repeat(np.arange(len(found)), lengths)
        order = np.argsort(sig)
        first = np.concatenate(([True], sig[order][1:] != sig[order][:-1]))
        many = np.diff(np.append(np.flatnonzero(first), len(sig))) > 1
        shared = np.empty(len(sig), bool)
        shared[order] = np.repeat(many, np.diff(np.append(np.flatnonzero(first), len(sig))))
        send = order[first]
        cut = owner * 256 + (sig & np.uint64(255)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1])))  # a cut's signatures stand together
        tag, seen = cut[start] % 256, np.add.reduceat(shared.astype(np.int64), start)
        of = keys[owner[start]]
        told = (seen << 36) | (need[start].astype(np.int64) << 8) | tag
        own = (mix(of.view(np.uint64) + tag.astype(np.uint64)) | np.uint64(TOLD)).view(np.int64)
        null = np.concatenate((shared[send], np.zeros(len(start), bool)))
        return _batch(
            "sig key told",
            np.concatenate((sig[send].view(np.int64), own)),
            pa.array(np.concatenate((keys[owner[send]], of)), mask=null),
            np.concatenate((np.zeros(len(send), np.int64), told)),
        )

    def run(batches):
        seen = set()
        for b in batches:
            found = []
            for _, u in shingle_sets(bytesops.texts_of(b.column("text"))):
                key = name_of(u)
                if key not in seen:
                    seen.add(key)
                    sigs, needs = sign(u)
                    if len(sigs):
                        found.append((key, sigs, needs))
            if found:
                yield rows(found)

    return common.in_arrow(docs.where("doc_id is not null").select("text"), run, "sig long, key long, told long", "jaccard")


def live_sets(docs: DataFrame) -> DataFrame:
    """(key,) of the sets that share enough signatures with others for a partner."""
    same = Window.partitionBy("sig")
    marked = signature_rows(docs).select("*", (F.min("key").over(same) != F.max("key").over(same)).alias("mixed"), F.max(F.col("key").isNull()).over(same).alias("seen"))
    told = F.col("told")
    tag = F.when(told == 0, F.col("sig")).otherwise(told).bitwiseAND(255).alias("tag")
    count = F.when(told == 0, F.lit(1)).otherwise(F.shiftright("told", 36))
    need = F.shiftright("told", 8).bitwiseAND((1 << 28) - 1)
    kept = marked.where(F.col("key").isNotNull() & (F.col("mixed") | F.col("seen") | (told != 0)))
    # a copy that another task has met again counts twice, which keeps more sets, not fewer
    sums = kept.groupBy("key", tag).agg(F.sum(count).alias("c"), F.max(need).alias("need"))
    return sums.where("c >= need and c > 0").select("key").distinct()


def texts_of_sets(docs: DataFrame, owners: DataFrame, rows: int) -> DataFrame:
    """(key, n, text) of the sets named in ``owners`` (doc_id, key), from those documents."""
    flagged = common.marked(docs.select("doc_id", "text"), "doc_id", common.id_bitmap(owners, "doc_id", rows)).where("_maybe").drop("_maybe")
    wanted = flagged.join(owners.withColumnRenamed("key", "wanted"), "doc_id").select("wanted", "text")

    def run(batches):
        seen = set()
        for b in batches:
            wanted, keep, sizes = b.column("wanted").to_pylist(), [], []
            for i, u in shingle_sets(bytesops.texts_of(b.column("text"))):
                if wanted[i] not in seen and name_of(u) == wanted[i]:
                    seen.add(wanted[i])
                    keep.append(i)
                    sizes.append(len(u))
            part = b.take(pa.array(keep, pa.int64()))
            yield _batch("key n text", part.column("wanted"), np.array(sizes, np.int64), part.column("text"))

    return common.in_arrow(wanted, run, "key long, n long, text string", "jaccard")


def signed(sets: DataFrame, one_in: int = 1) -> DataFrame:
    """(sig, key, need) and the other columns of ``sets`` but n and text; a part of the signatures if ``one_in`` is more."""
    others = [f for f in sets.schema.fields if f.name not in ("key", "n", "text")]

    def run(batches):
        for b in batches:
            found, places, needs = [], [], []
            for i, u in shingle_sets(bytesops.texts_of(b.column("text"))):
                sigs, need = sign(u)
                take = (sigs >> np.uint64(8)) % np.uint64(one_in) == 0
                found.append(sigs[take])
                needs.append(need[take])
                places.append(np.full(int(take.sum()), i, np.int64))
            if found:
                at = pa.array(np.concatenate(places))
                yield _batch("sig need key " + " ".join(f.name for f in others), np.concatenate(found).view(np.int64), np.concatenate(needs), b.column("key").take(at), *(b.column(f.name).take(at) for f in others))

    schema = "sig long, need int, key long" + "".join(f", {f.name} long" for f in others)
    return common.in_arrow(sets, run, schema, "jaccard")


def choose_leads(rows: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(key, lead) by the signatures in ``rows`` (sig, key).

    A set's weight is the size of all its groups together; the heaviest set leads a
    group, and a set follows the one that leads most of its groups.
    """
    sizes = rows.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    total = scratch.gather(sizes, f"{name}-sizes").agg(F.sum("size")).first()[0] or 0
    sizes = scratch.read(f"{name}-sizes")
    grouped = scratch.gather(common.join_split(rows.select("sig", "key"), sizes.withColumn("copies", F.col("size")), "sig", "copies", total), f"{name}-grouped")
    weights = grouped.groupBy("key").agg(F.sum("size").alias("w"))
    leads = grouped.join(weights, "key").groupBy("sig").agg(F.max_by("key", F.struct("w", "key")).alias("lead"), F.max("size").alias("copies"))
    leads = scratch.gather(leads, f"{name}-leads")
    votes = common.join_split(grouped.select("sig", "key"), leads, "sig", "copies", total).groupBy("key", "lead").agg(F.count("*").alias("c"))
    chosen = scratch.gather(votes.groupBy("key").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead")), f"{name}-chosen")
    for part in ("sizes", "grouped", "leads"):
        scratch.drop(f"{name}-{part}")
    return chosen


def follow(chosen: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(key, chosen): the leader at the end of each one's chain of leaders, within ``HOPS`` doublings.

    A leader is at least as heavy as its followers, so chains end, at sets that lead
    themselves; one outside the table ends a chain, too.  Copies of one text follow its
    most central version this way even where they share more with each other.
    """
    for hop in range(HOPS):
        onward = chosen.select(F.col("key").alias("chosen"), F.col("chosen").alias("further"))
        chosen = chosen.join(onward, "chosen", "left").select("key", F.coalesce("further", "chosen").alias("chosen"))
        chosen = scratch.gather(chosen, f"{name}-{hop}")
    return chosen


class _Sets:
    """Sets of one side of a cell, by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(u) for u in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def linked(self, u: np.ndarray) -> np.ndarray:
        """Places of the sets that link with u."""
        low = np.searchsorted(self.values, u, "left")
        count = np.searchsorted(self.values, u, "right") - low
        low, count = low[count > 0], count[count > 0]
        if not len(count):
            return low
        at = np.arange(count.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        both = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= PERCENT * (self.sizes + len(u) - both)))


def meet(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (a, b) between the two sides of each cell.

    ``sets`` has (key, text), ``parts`` has (cell, i, j, side, key, label) with labels
    that are equal where sets are known to be joined.  A task holds side 0 of a cell
    and one set of side 1 at a time, and returns a link only where it joins labels.
    """

    def run(batches):
        cell, left, index, above = None, [], None, {}

        def root(x):
            while above.get(x, x) != x:
                x = above[x]
            return x

        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in ("cell", "i", "j"))))
            sides, keys, labels = (b.column(c).to_pylist() for c in ("side", "key", "label"))
            found = []
            for i, u in shingle_sets(bytesops.texts_of(b.column("text"))):
                if places[i] != cell:
                    cell, left, index, above = places[i], [], None, {}
                if not sides[i]:
                    left.append((keys[i], labels[i], u))
                    continue
                if not left:
                    continue
                if index is None:
                    index = _Sets([x for _, _, x in left])
                    left = [(k, x, None) for k, x, _ in left]
                for t in index.linked(u).tolist():
                    x, y = root(left[t][1]), root(labels[i])
                    if x != y:
                        above[max(x, y)] = min(x, y)
                        found.append((left[t][0], keys[i]))
            yield _batch("a b", *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)))

    dealt = parts.join(sets.select("key", "text"), "key").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "key")
    return common.in_arrow(dealt.select("cell", "i", "j", "side", "key", "label", "text"), run, "a long, b long", "jaccard")


def _salt(of, k):
    return F.pmod(F.xxhash64(of, F.lit(7)), k).cast("int")


def with_leads(members: DataFrame) -> DataFrame:
    """Parts in which every member meets its lead; (key, lead) with lead <> key."""
    sizes = members.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("k"))
    few = F.col("k") == 1
    # members of small groups need no second look at their group's size
    large = sizes.where(~few)
    leads = sizes.select(F.col("lead").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("lead").alias("key"), F.col("lead").alias("label"))
    rest = members.join(large, "lead", "left").select(F.col("lead").alias("cell"), _salt("key", F.coalesce("k", F.lit(1))).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "key", F.col("key").alias("label"))
    return leads.unionByName(rest)


def in_cells(members: DataFrame) -> DataFrame:
    """Parts of a grid for each cell of (cell, key, label, n, outside): sets outside meet all."""
    sizes = members.groupBy("cell").agg(*(F.ceil(F.sum(x) / CELL).cast("int").alias(k) for x, k in ((F.when(F.col("outside"), F.col("n")), "ki"), (F.col("n"), "kj")))).where("ki > 0")
    placed = members.join(sizes, "cell")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("outside").select("cell", _salt("key", F.col("ki")).alias("i"), across("kj").alias("j"), F.lit(0).alias("side"), "key", "label")
    right = placed.select("cell", across("ki").alias("i"), _salt("key", F.col("kj")).alias("j"), F.lit(1).alias("side"), "key", "label")
    return left.unionByName(right)


def open_rows(sets: DataFrame, groups: list[str], scratch: common.Scratch, name: str) -> DataFrame:
    """(sig, key, need, size, label, groups...) of the sets that need further comparisons.

    A signature is open if its sets have more than one label, and more than one value
    in each column of ``groups``, in which sets with one value have all been compared;
    a set is open if it has as many open signatures as its need.
    """
    rows = signed(sets)
    split = [F.min(c) != F.max(c) for c in ["label", *groups]]
    every = split[0]
    for one in split[1:]:
        every = every & one
    opened = scratch.gather(rows.groupBy("sig").agg(every.alias("open"), F.count("*").alias("size")).where("open").select("sig", "size"), f"{name}-opened")
    total = opened.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.limit(0).withColumn("size", F.lit(0).cast("long"))
    kept = common.join_split(rows, opened.withColumn("copies", F.col("size")), "sig", "copies", total)
    kept = scratch.gather(kept, f"{name}-kept")
    enough = kept.groupBy("key", F.col("sig").bitwiseAND(255).alias("tag")).agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need")
    enough = enough.select("key", "tag")
    return scratch.gather(kept.withColumn("tag", F.col("sig").bitwiseAND(255)).join(enough, ["key", "tag"], "left_semi"), f"{name}-open")


def by_signature(rows: DataFrame, sets: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Links of open sets that meet at their signatures but the need - 1 most frequent ones."""
    lists = rows.groupBy("key", "tag").agg(F.max("label").alias("label"), F.max("need").alias("need"), F.array_sort(F.collect_list(F.struct("size", "sig"))).alias("s"))
    kept = lists.select("key", "label", F.explode(F.slice("s", F.lit(1), F.size("s") - F.greatest("need", F.lit(1)) + 1)).alias("s"))
    members = kept.select(F.col("s.sig").alias("cell"), "key", "label").join(sets.select("key", "n"), "key").withColumn("outside", F.lit(True))
    return meet(sets, in_cells(scratch.gather(members, "met")))


def set_links(docs: DataFrame, info: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(a, b) links between names of sets, enough to join every component."""
    live = scratch.gather(live_sets(docs), "live-keys")
    owners = info.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(live, "key", "left_semi")
    owners = scratch.gather(owners.select("doc_id", "key"), "owners")
    sets = scratch.save(texts_of_sets(docs, owners, owners.count()), "sets")
    # one look at the leader for each set
    chosen = choose_leads(signed(sets, VOTING).select("sig", "key"), scratch, "first")
    links = scratch.save(meet(sets, with_leads(chosen.where("key <> lead"))), "first")
    labels = links.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("label"))
    left = sets.join(chosen, "key", "left").join(labels, "key", "left")
    left = scratch.gather(left.select("key", "n", "text", F.coalesce("label", "key").alias("label"), F.coalesce("lead", "key").alias("chosen")), "labelled")
    groups: list[str] = []
    for k in range(ROUNDS):
        rows = open_rows(left, groups, scratch, f"round-{k}")
        if rows.isEmpty():
            return links
        if k:
            chosen = choose_leads(rows, scratch, f"round-{k}").withColumnRenamed("lead", "chosen")
            left = left.join(chosen, "key")
        else:
            left = left.join(rows.select("key").distinct(), "key", "left_semi")
        group = f"group_{k}"
        left = scratch.gather(left, f"left-{k}")
        groups_of = follow(left.select("key", "chosen"), scratch, f"follow-{k}")
        left = scratch.gather(left.drop("chosen").join(groups_of.withColumnRenamed("chosen", group), "key"), f"grouped-{k}")
        # most sets of a group have the most frequent label; the others meet all
        sizes = left.groupBy(group, "label").agg(F.count("*").alias("c"))
        mains = sizes.groupBy(group).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("c")).where("c > 1").drop("c")
        members = left.join(mains, group).select(F.col(group).alias("cell"), "key", "label", "n", (F.col("label") != F.col("main")).alias("outside"))
        links = links.unionByName(scratch.save(meet(left, in_cells(scratch.gather(members, f"members-{k}"))), f"links-{k}"))
        groups.append(group)
    rows = open_rows(left, groups, scratch, "last")
    if rows.isEmpty():
        return links
    return links.unionByName(scratch.save(by_signature(rows, left, scratch), "links-last"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = common.Scratch(docs.sparkSession, "jaccard")
    info = scratch.save(describe(docs), "info")
    links = set_links(docs, info, scratch)

    # ids with several texts join these; then each set's component has a least id
    named = info.where("key is not null and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = scratch.gather(named.join(several, "doc_id").select("a", F.col("key").alias("b")).distinct(), "same-id")
    joined = components(links.unionByName(same_id), scratch, "all")
    once = named.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    once = scratch.gather(once.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "once")
    least = once.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("sets"), F.sum("copies").alias("copies")).where("copies > 1")
    rows = info.count()
    found = scratch.gather(common.join_split(once.select("key", "root", F.col("copies").alias("own")), least.drop("sets"), "root", "copies", rows), "least")
    placed = common.join_split(info, found.select("key", "least", F.col("own").alias("copies")), "key", "copies", rows, "left")
    # rows without words follow the other rows of their id
    empty = info.where("n = 0 and doc_id is not null").select("doc_id").distinct()
    kin = scratch.gather(named.join(empty, "doc_id").select("doc_id", "key").distinct(), "kin")
    if not kin.isEmpty():
        kin = kin.join(found.select("key", "least"), "key", "left").groupBy("doc_id").agg(F.min(F.coalesce("least", "doc_id")).alias("kin"))
        placed = placed.join(kin, "doc_id", "left").withColumn("least", F.coalesce("least", "kin"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least id; all columns.

    Rows without an id stay, and so do all rows that repeat the least id.
    """
    scratch = common.Scratch(docs.sparkSession, "copies")
    dropped = scratch.gather(link_components(docs).where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    return common.without(docs, "doc_id", dropped, dropped.count())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(common.table(spark, sf_dir, "documents"))
