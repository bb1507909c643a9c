"""N-gram Jaccard join of whole documents by grouped prefixes, and the components of its links.

A document is its set of five-word shingles, as 64-bit hashes. Under one global order of shingles,
rarest first, two sets that link share one of their first ``n - ceil(0.75 n) + 1`` shingles. So:

1. Texts are read once into blocks of bounded size, and each block asks every bucket of the shingle
   space how frequent its shingles are. A shingle's level is 0 if one set of one block has it, else it
   grows with the number; the order is by level, then hash. Buckets know a shingle by 36 bits: two that
   they take for one share a level, which changes the order for all sets alike and no result.
2. Documents with one prefix and one size are one group, and groups, not documents, are posted
   under their prefix shingles; a shingle of level 0 has no other group and is not posted. Sets with
   postings are stored once, the rest have no partner.
3. Group pairs that pass the size and position filters are expanded to their distinct sets and
   verified: first by parity signatures, then by the sets. So are the distinct sets of a group.
4. Every group is paired with drawn centres of each of its shingles, of its own size and the next, and
   those that are outside a shingle's largest component with a few drawn groups of each other one.
   Only what these links have not joined can change the components: of the shingles whose groups
   still lie in several, all pairs across components that pass the filters are verified. Nothing that
   could join two components is left out.

Copies are one set with many documents, and a group of near copies costs its members, not its
pairs, once its centres have joined it. A shingle that a third of all documents hold makes one posting
for each distinct group. Nothing grows on the driver.

``component_id`` is the smallest doc_id that links reach. Null and empty texts and texts without
words have no shingles and link with nothing. Very long texts are taken whole, each a block of its own
beyond the bound. Rows that repeat a text link with each other, also under one doc_id; a null doc_id
never names a component unless it has no other. Extra columns are never read, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .blocks import parts, settled, written
from .components import connected_components

SHINGLE = 5
#: Documents link at this many hundredths of their union.
PERCENT = 75
#: Shingles in a block, and in a bucket at once.
BLOCK = 1 << 20
BUCKET = 4 << 20
#: Bits by which buckets know a shingle.
KEY_BITS = 36
#: Groups of a component that the others of a shingle are tried with before all.
TRIED = 8
#: Words of 64 bits in the map of a set that joins of groups compare.
MAPS = 8
#: Centres drawn for the groups of one shingle and size.
CENTRES = 2
_SEED = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted hashes."""
    for piece in w.pieces(texts):
        words = w.find_words(*w.buffers(piece), w.NOT_SPACE, w.LOWER)
        h = words.hashes()
        grams = w.sequence_hashes(h, k)
        first = words.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                s = np.sort(grams[a:b - k + 1])
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif b > a:  # the whole sequence, told from a shingle by its length
                yield w.mix(w.sequence_hashes(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same in any order."""
    return int(w.mix(s).sum(dtype=np.uint64)), int(w.mix(s ^ _SEED).sum(dtype=np.uint64))


def _name(c: tuple[int, int]) -> bytes:
    return c[0].to_bytes(8, "big") + c[1].to_bytes(8, "big")


def _keys(s: np.ndarray) -> np.ndarray:
    return s >> np.uint64(64 - KEY_BITS)


def _read(doc_type: pa.DataType):
    """Kind 0: rows of documents. Kinds 1 and 2: a block's distinct texts, and the keys that it asks
    about with the number of its sets that hold each."""
    kinds = {"kind": pa.int32(), "doc_id": doc_type, "n_shingles": pa.int64(), "cls": pa.binary(), "block": pa.string(), "data": pa.binary()}

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.record_batch([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), t) for c, t in kinds.items()], names=list(kinds))

    def block(texts: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
        name = uuid.uuid4().hex
        keys = np.sort(_keys(np.concatenate(sets)))
        new = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
        many = np.minimum(np.diff(np.append(new, len(keys))), 0xFFFF).astype(np.uint16)
        asked = w.pack_sorted(keys[new], many)
        return rows(kind=[1, 2], block=[name, name], data=[w.pack(text=pa.concat_arrays(texts)), asked])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sets, seen, held = [], [], set(), 0
        for batch in batches:
            n, cls, fresh, at = [], [], [], 0
            column = w.compact(batch.column("text"))
            for k, s in enumerate(shingle_sets(column)):
                n.append(len(s))
                cls.append(_name(_fingerprint(s)) if len(s) else None)
                if not len(s) or cls[-1] in seen:
                    continue
                seen.add(cls[-1])
                fresh.append(k)
                sets.append(s)
                held += len(s)
                if held >= BLOCK:
                    texts.append(column.take(pa.array(fresh)))
                    yield block(texts, sets)
                    texts, sets, seen, held, fresh = [], [], set(), 0, []
            if fresh:
                texts.append(column.take(pa.array(fresh)))
            yield rows(kind=[0] * len(n), doc_id=batch.column("doc_id"), n_shingles=n, cls=cls)
        if sets:
            yield block(texts, sets)

    return read


def _split(buckets: int):
    """A block's keys, dealt to the buckets of the key space in order."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                keys, many = w.unpack_sorted(data)
                bounds = np.array([-(-(b << KEY_BITS) // buckets) for b in range(buckets + 1)], np.uint64)
                cut = np.searchsorted(keys, bounds)
                some = np.flatnonzero(np.diff(cut))
                pieces = [w.pack_sorted(keys[a:b], many[a:b]) for a, b in zip(cut[some].tolist(), cut[some + 1].tolist(), strict=True)]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([name] * len(some)), pa.array(pieces, pa.binary())], names=["bucket", "block", "data"])

    return split


def _tell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of the keys that each block has asked one bucket about, in the blocks' orders."""
    names, asked, many = [], [], []
    for batch in batches:
        names += batch.column("block").to_pylist()
        for data in batch.column("data").to_pylist():
            for have, got in zip((asked, many), w.unpack_sorted(data), strict=True):
                have.append(got)
    keys, sets = np.concatenate(asked), np.concatenate(many)
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=keys[order[0]] + np.uint64(1)) != 0
    total = np.add.reduceat(sets[order].astype(np.int64), np.flatnonzero(new))
    level = np.where(total > 1, np.minimum(1 + (8 * np.log2(total)).astype(np.int64), 255), 0).astype(np.uint8)
    each = np.empty(len(keys), np.uint8)
    each[order] = level[np.cumsum(new) - 1]
    cut = np.cumsum([len(x) for x in asked])[:-1]
    told = [w.pack(level=x) for x in np.split(each, cut)]
    yield pa.record_batch([pa.array(names), pa.array([key[0].as_py()] * len(names), pa.int32()), pa.array(told, pa.binary())], names=["block", "bucket", "data"])


def _post(percent: int):
    kinds = {"kind": pa.int32(), "token": pa.int64(), "gid": pa.int64(), "n": pa.int64(), "at": pa.int64(), "cls": pa.binary(), "sig": pa.binary(), "data": pa.binary(), **{f"m{k}": pa.int64() for k in range(MAPS)}}

    def post(key: tuple, table: pa.Table) -> pa.Table:
        """A block's postings (kind 0) and the sets that have any (kind 1)."""
        texts = w.unpack(table.column("texts")[0].as_py()).column("text")
        level = np.concatenate([w.column(w.unpack(x["data"]), "level") for x in table.column("told")[0].as_py()])
        sets = list(shingle_sets(texts))
        keys = np.unique(_keys(np.concatenate(sets)))
        posted, kept = [np.zeros((4, 0), np.int64)], {c: [] for c in ("gid", "n", "cls", "sig", "data", *(f"m{k}" for k in range(MAPS)))}
        for s in sets:
            own = level[np.searchsorted(keys, _keys(s))]
            first = np.argsort(own, kind="stable")[:len(s) - -(-percent * len(s) // 100) + 1]
            at = np.flatnonzero(own[first])
            if not len(at):
                continue
            group = w.mix(w.mix(s[first]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]
            same = np.full(len(at), 1, np.int64)
            posted.append(np.stack([s[first][at].view(np.int64), same * group, same * len(s), at]))
            for c, x in zip(kept, (group, len(s), _name(_fingerprint(s)), _signature(s), s.tobytes(), *_map(s)), strict=True):
                kept[c].append(x)
        token, gid, n, at = np.concatenate(posted, axis=1)
        p, q = len(token), len(kept["gid"])
        columns = {"kind": np.repeat([0, 1], [p, q]), "token": token, "gid": np.concatenate([gid, np.array(kept["gid"], np.int64)]), "n": np.concatenate([n, np.array(kept["n"], np.int64)]), "at": at}
        out = []
        for c, t in kinds.items():
            x = columns.get(c)
            if x is None:
                out.append(pa.array([None] * p + kept[c], t))
            else:
                out.append(pa.concat_arrays([pa.array(x, t), pa.nulls(p + q - len(x), t)]))
        return pa.table(out, names=list(kinds))

    return post


def _signature(s: np.ndarray) -> bytes:
    """A parity bit map of a set, of at least as many bits as the set has members. Half of a map folded
    on the other half is the map of half the size, so maps of any sizes compare."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    at = (w.mix(s ^ _SEED) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _map(s: np.ndarray) -> list[int]:
    """A parity bit map of MAPS words, whatever the set's size."""
    at = (w.mix(s + _SEED) % np.uint64(64 * MAPS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * MAPS) & 1).astype(np.uint8)).view(np.int64).tolist()


def _may_link(percent: int):
    """Bits in which two parity maps differ are never more than the members in one set alone, of
    which linked sets have at most (100 - percent) / (100 + percent) of their sizes' sum."""
    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(batch.column("sa"), batch.column("sb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                size = min(len(s), len(t))
                s, t = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (s, t))
                apart = int(np.bitwise_count(s ^ t).sum())
                keep.append((100 + percent) * apart <= (100 - percent) * (n + m))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return may


def _check(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("da"), batch.column("db"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                place = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[place] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) of sets, those that link. Sizes and signatures come first; only the sets of the
    pairs left travel."""
    sides = [sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in ("a", "b")]
    near = pairs.join(sides[0], "a").join(sides[1], "b").where(_sizes_fit(F.col("na"), F.col("nb"), percent))
    near = written(near.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_may_link(percent), "a binary, b binary"), "ngram-near")
    left, right = (sets.select(F.col("cls").alias(k), F.col("data").alias(f"d{k}")) for k in ("a", "b"))
    return near.join(left, "a").join(right, "b").select("a", "b", "da", "db").mapInArrow(_check(percent), "a binary, b binary")


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _position_fits(percent: int) -> str:
    """Whether sets a and b whose first common shingle is their at-th can still link: what follows must
    hold the members that linked sets of these sizes share."""
    return f"{100 + percent} * least(a_n - a_at, b_n - b_at) >= {percent} * (a_n + b_n)"


def _placed(sets: DataFrame, links: DataFrame) -> DataFrame:
    """cls, gid, part: sets with the component that these links give them."""
    joined = connected_components(links).withColumnRenamed("node", "cls")
    return settled(sets.select("cls", "gid").join(joined, "cls", "left").select("cls", "gid", F.coalesce("root", "cls").alias("part")), "ngram-placed")


def _still_open(posts: DataFrame, placed: DataFrame) -> DataFrame:
    """Postings of the shingles whose groups are in several components, each with the least and
    greatest of its group's components."""
    posts = posts.join(placed.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high")), "gid")
    mixed = posts.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("token")
    return posts.join(mixed, "token")


def _drawn(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups, linear in the postings: each with the centres of its shingle that have its own
    size and the next."""
    band = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")
    posts = posts.withColumn("band", band)
    centre = posts.groupBy("token", "band").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), "gid").alias("draw"), "gid", "n", "at")).alias(f"c{k}") for k in range(CENTRES)))
    centre = centre.withColumn("c", F.explode(F.array_distinct(F.array(*(F.struct(f"c{k}.gid", f"c{k}.n", f"c{k}.at") for k in range(CENTRES))))))
    centre = centre.select("token", F.col("c.gid").alias("b_gid"), F.col("c.n").alias("b_n"), F.col("c.at").alias("b_at"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    own = posts.select("token", "band", F.col("gid").alias("a_gid"), F.col("n").alias("a_n"), F.col("at").alias("a_at"))
    pairs = own.join(centre, ["token", "band"]).where("a_gid <> b_gid").where(_position_fits(percent))
    return pairs.select(F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid")).distinct()


def _across(still_open: DataFrame, sets: DataFrame, percent: int, tried: int | None = None) -> DataFrame:
    """All pairs of groups (or, of each component of a shingle, only its first ``tried`` by hash, paired with the groups
    outside the largest) that share a shingle, lie in several components and pass the filters: of
    size, position and, for groups of one set, of parity maps (see _may_link). One group of a pair is
    outside the shingle's largest component, so that is never paired with itself."""
    maps = [f"m{k}" for k in range(MAPS)]
    still_open = still_open.join(sets.groupBy("gid").agg(*(F.when(F.count("*") == 1, F.min(m)).alias(m) for m in maps)), "gid")
    parts_of = still_open.groupBy("token", "low").agg(F.count("*").alias("m"))
    largest = parts_of.groupBy("token").agg(F.max(F.struct("m", "low")).alias("big")).select("token", F.col("big.low").alias("big"))
    marked = still_open.join(largest, "token").withColumn("in_big", F.expr("low = big and high = big"))
    marked = written(marked.select("token", "gid", "n", "at", "low", "high", "in_big", *maps), "ngram-marked")
    x, y = (marked.select("token", *(F.col(c).alias(f"{k}_{c}") for c in ("gid", "n", "at", "low", "high", "in_big", *maps))) for k in ("a", "b"))
    differ = " + ".join(f"bit_count(a_{m} ^ b_{m})" for m in maps)
    alike = f"coalesce({100 + percent} * ({differ}) <= {100 - percent} * (a_n + b_n), true)"
    once = "(b_in_big or a_gid < b_gid) and a_gid <> b_gid"
    if tried is not None:  # the same groups of a component for all its shingles, as far as they hold them
        few = marked.withColumn("nth", F.row_number().over(Window.partitionBy("token", "low").orderBy(F.xxhash64("gid"), "gid"))).where(F.col("nth") <= tried)
        y = few.select("token", *(F.col(c).alias(f"b_{c}") for c in ("gid", "n", "at", "low", "high", "in_big", *maps)))
        once = "a_gid <> b_gid"
    apart = "not (a_low = a_high and b_low = b_high and a_low = b_low)"
    pairs = x.where("not a_in_big").join(y, "token").where(f"{once} and {apart} and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)").where(_position_fits(percent)).where(alike)
    return pairs.select(F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid")).distinct()


def _components_of_sets(texts: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """cls, root: of the sets that have partners, the components of their links."""
    posted = texts.join(told, "block").groupBy("block").applyInArrow(_post(percent), "kind int, token long, gid long, n long, at long, cls binary, sig binary, data binary, " + ", ".join(f"m{k} long" for k in range(MAPS)))
    posted = written(posted, "ngram-posted")
    posts = posted.where("kind = 0").select("token", "gid", "n", "at").distinct()
    posts = written(posts.join(posts.groupBy("token").count().where("count > 1").select("token"), "token"), "ngram-posts")
    sets = posted.where("kind = 1").drop("kind", "token", "at").dropDuplicates(["cls"])
    several = posted.where("kind = 1").groupBy("gid").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least <> most")
    sets = written(sets.join(posts.select("gid").union(several.select("gid")).distinct(), "gid", "left_semi"), "ngram-sets")
    leaders = settled(sets.groupBy("gid").agg(F.min("cls").alias("leader"), F.count("*").alias("sets")), "ngram-leaders")
    ga, gb = (leaders.select(F.col("gid").alias(f"{k}_gid"), F.col("leader").alias(k)) for k in ("a", "b"))

    inside = sets.select("cls", "gid").join(leaders.where("sets > 1"), "gid").where("cls <> leader").select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    drawn = _drawn(posts, percent).join(ga, "a_gid").join(gb, "b_gid").select("a", "b")
    links = settled(_verified(inside.union(drawn.where("a <> b")).distinct(), sets, percent), "ngram-links")

    tried = _across(_still_open(posts, _placed(sets, links)), sets, percent, TRIED).join(ga, "a_gid").join(gb, "b_gid").select("a", "b")
    links = settled(links.union(_verified(tried.where("a <> b"), sets, percent)), "ngram-links")

    # what is still open: all pairs across components, and those that the sets of one group give
    placed = _placed(sets, links)
    groups = _across(_still_open(posts, placed), sets, percent)
    x, y = (placed.select(F.col("gid").alias(f"{k}_gid"), F.col("cls").alias(k), F.col("part").alias(f"{k}_part")) for k in ("a", "b"))
    rest = groups.join(x, "a_gid").join(y, "b_gid").where("a_part <> b_part").select("a", "b")
    mixed = placed.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("gid")
    open_groups = placed.join(mixed, "gid")
    x, y = (open_groups.select("gid", F.col("cls").alias(k), F.col("part").alias(f"{k}_part")) for k in ("a", "b"))
    within = x.join(y, "gid").where("a_part < b_part").select("a", "b")
    links = links.union(_verified(rest.union(within).distinct(), sets, percent))
    return connected_components(links).select(F.col("node").alias("cls"), "root")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id; one row a document."""
    named = docs.select("doc_id", "text")
    kind = dict(named.dtypes)["doc_id"]
    doc_type = pa.schema(named.limit(0).toArrow().schema).field("doc_id").type
    read = written(named.mapInArrow(_read(doc_type), f"kind int, doc_id {kind}, n_shingles long, cls binary, block string, data binary"), "ngram-read")
    rows = read.where("kind = 0").select("doc_id", "n_shingles", "cls")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(parts(docs.sparkSession), -(-total // BUCKET))
    asked = read.where("kind = 2").select("block", "data").mapInArrow(_split(buckets), "bucket int, block string, data binary")
    told = asked.groupBy("bucket").applyInArrow(_tell, "block string, bucket int, data binary")
    told = told.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "data"))).alias("told"))
    texts = read.where("kind = 1").select("block", F.col("data").alias("texts"))
    final = _components_of_sets(texts, told, percent)
    out = rows.join(final, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = out.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return out.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with, of each component, only the row with the smallest id (nulls last, then by a hash
    of the text); of rows equal in doc_id and text, one."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), percent)
    lost = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    marks = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(lost).alias("lost")).where("lost or n > 1")
    names = []
    for name in ("mark_id", "mark_tie", "mark_lost"):
        while name in {c.lower() for c in docs.columns}:
            name += "_"
        names.append(name)
    i, tie, gone = names
    marks = marks.select(F.col("doc_id.id").alias(i), F.col("doc_id.tie").alias(tie), F.col("lost").alias(gone))
    marked = docs.join(marks, docs.doc_id.eqNullSafe(marks[i]) & (F.xxhash64(docs.text) == marks[tie]), "left")
    again = marked.where(~F.col(gone)).select(docs.columns).dropDuplicates(["doc_id", "text"])
    return marked.where(F.col(gone).isNull()).select(docs.columns).union(again)


#: The same in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, pos, pos + 4), ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
c AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.reached) AS component_id
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
