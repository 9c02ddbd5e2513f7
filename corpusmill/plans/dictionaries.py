"""Arrays relabelled by a large table, without a row per value in any shuffle or sort.

Rows come in blocks of about ``PLACE_ROWS``, as they were written. A block's distinct values meet the table once, by a
join, and come back as the block's dictionary. One shuffle by block brings rows and dictionaries together, the
dictionary first; a task reads them in that order and replaces the values of a batch of rows at a time, in Arrow. It
holds one block's dictionary, whatever the size of the table, and a value that all rows have is one row a block.

``code_blocks`` goes further where the rows are written anyway: they are written as numbers into their block's own list of
values, and no text is shuffled any more, only numbers (``coded_values``). These are packed (``packed``): about two bytes a value
in every shuffle and file.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

#: Rows of a block that is numbered by place, and values that a task takes.
PLACE_ROWS, TASK_VALUES = 4_000, 4_000_000
#: Rows and values of a block that ``code_blocks`` writes, at most: the larger the blocks, the fewer values are listed several times.
BLOCK_ROWS, BLOCK_VALUES = 16_000, 4_000_000


def block_of_place(rows: int = PLACE_ROWS) -> Column:
    """The number of a row's block by its place in the scan: written with the row, it does not change."""
    m = F.monotonically_increasing_id()
    place = F.expr(f"{(1 << 33) - 1}L")
    return F.shiftleft(F.shiftright(m, 33), 32) + F.floor(m.bitwiseAND(place) / F.lit(rows)).cast("bigint")


def _relabelled(skip: list | None, flat_out: bool = False):
    def of(part: pa.RecordBatch, names: pa.Array | None, given: pa.Array | None, kind: pa.DataType) -> pa.RecordBatch:
        lists = part.column("_values")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        found = pa.nulls(len(flat), kind) if names is None else given.take(pc.index_in(flat, value_set=names))
        other = part.column("_missing")[0]
        if other.is_valid:
            found = pc.if_else(pc.is_null(found), other, found)
        keep = pc.is_valid(found)
        if skip:
            keep = pc.and_(keep, pc.invert(pc.fill_null(pc.is_in(flat, value_set=pa.array(skip, flat.type)), False)))
        kept = keep.to_numpy(zero_copy_only=False)
        if not kept.all():
            before = np.concatenate(([0], np.cumsum(kept)))
            ends = np.cumsum(sizes)
            sizes = before[ends] - before[ends - sizes]
            found = found.filter(keep)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        if flat_out:  # the lists that stand for the values of a row, as one list
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False)))).astype(np.int32)[offsets]
            found = found.flatten()
        return pa.RecordBatch.from_arrays([part.column("_key"), pa.ListArray.from_arrays(pa.array(offsets), found)], ["_key", "_found"])

    def run(batches):
        block, names, given, pieces = None, None, None, []
        for b in batches:
            at = b.column("_block").to_numpy(zero_copy_only=False) * 2 + b.column("_row").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                part, own = b.slice(lo, hi - lo), int(at[lo]) >> 1
                if own != block:
                    block, names, given, pieces = own, None, None, []
                if not at[lo] & 1:
                    pieces.append((part.column("_by"), part.column("_out")))
                    continue
                if pieces:
                    names, given = (pa.concat_arrays([p[k] for p in pieces]) for k in (0, 1))
                    pieces = []
                yield of(part, names, given, part.schema.field("_out").type)

    return run


def relabel_blocks(rows: DataFrame, key: str, values: str, dim: DataFrame, by: str, out: str, total: int, missing: Column | None = None,
                   skip: list | None = None, broadcast: bool = False, task_values: int = TASK_VALUES, flat: bool = False) -> DataFrame:
    """``(key, out)`` for the written table ``rows (key, values, _block)`` with ``total`` values in all. With ``flat`` the lists that ``out``
    gives the values of a row are one list."""
    spark = rows.sparkSession
    own = rows.select("_block", F.explode(values).alias(by)).distinct()
    table = dim.select(by, out)
    found = own.join(F.broadcast(table) if broadcast else table, by)
    of = {f.name: f.dataType for f in [*rows.schema.fields, *dim.schema.fields]}
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    dictionary = found.select("_block", F.lit(0).alias("_row"), F.col(by).alias("_by"), F.col(out).alias("_out"), none("_key", of[key]),
                              F.array().cast(of[values]).alias("_values"), none("_missing", of[out]))  # no null lists: Arrow writes these slowly
    other = none("_missing", of[out]) if missing is None else missing.cast(of[out]).alias("_missing")
    texts = rows.select("_block", F.lit(1).alias("_row"), none("_by", of[by]), none("_out", of[out]), F.col(key).alias("_key"),
                        F.col(values).alias("_values"), other)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // task_values))
    dealt = dictionary.unionByName(texts).repartition(int(parts), "_block").sortWithinPartitions("_block", "_row")
    schema = StructType([StructField("_key", of[key]), StructField("_found", of[out] if flat else ArrayType(of[out]))])
    return dealt.mapInArrow(_relabelled(skip, flat), schema).select(F.col("_key").alias(key), F.col("_found").alias(out))


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of numbers as bytes: the lowest bytes of all values of a list, then the next ones, as many as its largest value has,
    behind their number; compressed. A negative number has all eight."""
    codec, out, ends = pa.Codec("zstd", compression_level=1), [], np.cumsum(sizes)
    values = values.astype("<i8").view("<u8")
    planes = values.view(np.uint8).reshape(-1, 8)
    for lo, hi in zip((ends - sizes).tolist(), ends.tolist()):
        k = max(1, (int(values[lo:hi].max()).bit_length() + 7) // 8) if hi > lo else 1
        out.append(bytes([k]) + codec.compress(planes[lo:hi, :k].T.tobytes(), asbytes=True))
    return pa.array(out, pa.binary())


def unpacked(lists: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The values of the lists of ``packed``, one behind the other."""
    codec, ends = pa.Codec("zstd"), np.cumsum(sizes)
    planes = np.zeros((int(ends[-1]) if len(ends) else 0, 8), np.uint8)
    for own, lo, hi in zip(lists, (ends - sizes).tolist(), ends.tolist()):
        if hi > lo:
            own = memoryview(own.as_buffer())
            planes[lo:hi, :own[0]] = np.frombuffer(codec.decompress(own[1:], own[0] * (hi - lo)), np.uint8).reshape(own[0], -1).T
    return planes.view("<i8").reshape(-1)


def _listed(values, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def packed_rows(rows: DataFrame, column: str, size: str = "n") -> DataFrame:
    """``rows`` with the lists of numbers of ``column``, ``size`` in each, packed."""
    def run(batches):
        for b in batches:
            lists = b.column(column)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            yield b.set_column(b.schema.get_field_index(column), column, packed(lists.flatten().to_numpy(zero_copy_only=False), sizes))

    return rows.mapInArrow(run, StructType([StructField(f.name, BinaryType()) if f.name == column else f for f in rows.schema.fields]))


def unpacked_rows(rows: DataFrame, column: str, size: str = "n") -> DataFrame:
    """``rows`` with the lists of ``packed_rows`` as numbers again."""
    def run(batches):
        for b in batches:
            sizes = b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = _listed(pa.array(unpacked(b.column(column), sizes)), sizes)
            yield b.set_column(b.schema.get_field_index(column), column, lists)

    return rows.mapInArrow(run, StructType([StructField(f.name, ArrayType(LongType())) if f.name == column else f for f in rows.schema.fields]))


def lots_of_rows(batches, values: str, rows: int, most: int):
    """Record batches of ``rows`` rows and about ``most`` values at most."""
    held, n, size = [], 0, 0
    for b in batches:
        lengths = pc.fill_null(pc.list_value_length(b.column(values)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = min(at + rows - n, int(np.searchsorted(ends, before + most - size, side="right")))
            upto = min(max(upto, at + 1 if not held else at), b.num_rows)
            if upto > at:
                held.append(b.slice(at, upto - at))
                n, size, at = n + upto - at, size + int(ends[upto - 1]) - before, upto
            if at < b.num_rows or n >= rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _coded(key: str, values: str, keep: tuple[str, ...], schema: pa.Schema, places: bool, most: tuple[int, int]):
    def block_of(rows: pa.RecordBatch, number: int):
        lists, keys = rows.column(values), rows.column(key).dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        own = lists.flatten().dictionary_encode()
        codes, names = own.indices.to_numpy(zero_copy_only=False), own.dictionary
        n, one = len(sizes), lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        texts = {key: rows.column(key), "n": pa.array(sizes), **{c: rows.column(c) for c in keep}, "_block": pa.array(np.full(n, number)), "_text": pa.array(np.ones(n, bool)),
                 "codes": packed(codes, sizes)}
        listed = {"_block": pa.array([number]), "_text": pa.array([False]), "names": one(names)}
        if places:
            found = places_of(rows.column(key), keys, sizes, ends, codes, len(names)) or first_of(rows, keys, sizes, ends, own.indices, np.repeat(np.arange(n), sizes))
            listed |= {c: one(a) for c, a in zip(("keys", "ks", "lost", "counts"), found)}
        none = lambda f, m: pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), pa.array([], f.type.value_type)).cast(f.type)
        for have, m in ((texts, n), (listed, 1)):
            yield pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else none(f, m) if pa.types.is_list(f.type) else pa.nulls(m, f.type)
                                              for f in schema], schema=schema)

    def places_of(own: pa.Array, keys, sizes, ends, codes, count: int) -> list[pa.Array] | None:
        """The same as ``first_of`` where each row has a key of its own: a value's first place is the first of all, row by row in the order of keys."""
        if own.null_count or len(keys.dictionary) != len(own):
            return None
        order = pc.sort_indices(own).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bits = max(1, int(sizes.max(initial=0)).bit_length())
        low = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(low, codes, np.repeat((rank << bits) - (ends - sizes), sizes) + np.arange(len(codes)))
        first = own.take(pa.array(order[low >> bits]))
        return [first, pa.array(low & ((1 << bits) - 1)), pa.nulls(count, pa.int64()), pa.array(np.bincount(codes, minlength=count))]

    def first_of(rows, keys, sizes, ends, codes, owner) -> list[pa.Array]:
        k = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        # keys in order as numbers, so that (key, k) is one number whatever the keys are
        order = pc.sort_indices(keys.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = keys.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lost = pc.is_null(rows.column(key)).to_numpy(zero_copy_only=False)[owner]
        bits = max(1, int(sizes.max(initial=0)).bit_length())
        place = ((rank[at] if len(rank) else at)[owner] << bits) + k
        g = pa.table({"code": codes, "place": pa.array(place, mask=lost), "lost": pa.array(k, mask=~lost)}).group_by("code", use_threads=False) \
            .aggregate([("place", "min"), ("lost", "min"), ([], "count_all")]).sort_by("code")
        low = g["place_min"].combine_chunks()
        first = keys.dictionary.take(pc.take(pa.array(order), pc.shift_right(low, bits)))
        return [first, pc.bit_wise_and(low, pa.scalar((1 << bits) - 1, pa.int64())), g["lost_min"].combine_chunks(), g["count_all"].combine_chunks()]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for own in lots_of_rows(batches, values, *most):
            yield from block_of(own, number)
            number += 1

    return run


def code_blocks(rows: DataFrame, key: str, values: str, keep: tuple[str, ...] = (), places: bool = True) -> DataFrame:
    """Rows for writing: with ``_text`` the rows ``(key, n, *keep, _block)`` and ``codes``, the places of their values in the block's list, packed; else
    one row a block, ``names``: its distinct values, each with the key and place (``keys``, ``ks``) where it stands first in the
    block, the first place in a row without a key (``lost``), and how often it stands there (``counts``); none of these without ``places``."""
    of = {f.name: f.dataType for f in rows.schema.fields}
    fields = [(key, of[key]), ("n", LongType()), *[(c, of[c]) for c in keep], ("_block", LongType()), ("_text", BooleanType()), ("codes", BinaryType()),
              ("names", of[values]), ("keys", ArrayType(of[key])), ("ks", ArrayType(LongType())), ("lost", ArrayType(LongType())), ("counts", ArrayType(LongType()))]
    schema = StructType([StructField(*f) for f in fields])
    run = _coded(key, values, tuple(keep), to_arrow_schema(schema), places, (BLOCK_ROWS, BLOCK_VALUES))
    return rows.select(key, *keep, values).mapInArrow(run, schema)


def first_places(coded: DataFrame, key: str, value: str) -> DataFrame:
    """``(value, key, k, lost, c)``: the values of each block of ``code_blocks`` with their first places and counts."""
    z = coded.where("NOT _text").select(F.explode(F.arrays_zip("names", "keys", "ks", "lost", "counts")).alias("z"))
    return z.select(F.col("z.names").alias(value), F.col("z.keys").alias(key), F.col("z.ks").alias("k"), F.col("z.lost").alias("lost"), F.col("z.counts").alias("c"))


def coded_values(coded: DataFrame, texts: DataFrame, dim: DataFrame, by: str, out: str, result: str, missing: int = -1, broadcast: bool = False,
                 values: str | None = None, own: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``texts`` (rows of a written ``code_blocks``, with ``n``, ``_block`` and ``codes``), with ``result``: the numbers that ``dim (by, out)`` gives their
    values, ``missing`` for those that have none, packed; with ``values``, a column of that name has the values themselves, and ``result`` is a list. The lists
    of the blocks meet the table, numbers come back; a task holds one block at a time. ``own (key, ...)``, one row for each key of
    ``texts``, is joined to them: it meets the slim ``(key, _block)``, and goes where the block goes."""
    listed = coded.where("NOT _text").select("_block", F.posexplode("names").alias("_code", by))
    table = dim.select(by, F.col(out).cast("bigint").alias("_out"))
    found = listed.join(F.broadcast(table) if broadcast else table, by).select(F.col("_block").alias("_of"), "_code", "_out")
    kinds = {f.name: f for f in [*texts.schema.fields, *(own.schema.fields if own is not None else [])]}
    more = [c for c in own.columns if c != key] if own is not None else []
    if own is not None:
        slim = texts.select(key, "_block").join(own, key).select(F.col("_block").alias("_of"), F.col(key).alias("_key"), *more)
        found = found.unionByName(slim, allowMissingColumns=True)
    names = [c for c in texts.columns if c not in ("_block", "codes")]
    if values:  # the block's list goes with its rows
        row = [F.lit(None).cast(kinds[c].dataType).alias(c) for c in [*names, "codes"]]
        texts = texts.withColumn("names", F.lit(None).cast(coded.schema["names"].dataType)).unionByName(coded.where("NOT _text").select("_block", "names", *row))

    def of(rows: pa.Table, given: pa.Table) -> pa.Table:
        if values:
            lists = rows["names"].combine_chunks()
            listed_, rows = lists.filter(pc.is_valid(lists)).flatten(), rows.filter(pc.is_null(rows["names"]))
        extra = {}
        if more:
            coming = given.filter(pc.is_valid(given["_key"]))
            given = given.filter(pc.is_valid(given["_code"]))
            at = pc.index_in(rows[key], value_set=coming["_key"].combine_chunks())
            rows, at = rows.filter(pc.is_valid(at)), at.drop_null()
            extra = {c: coming[c].take(at) for c in more}
        at, sizes = given["_code"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        flat = unpacked(rows["codes"].combine_chunks(), sizes)
        new = np.full(max(at.max(initial=-1), flat.max(initial=-1)) + 1, missing, np.int64)
        new[at] = pc.fill_null(given["_out"], missing).to_numpy()
        lists = [_listed(pa.array(new[flat]), sizes), _listed(listed_.take(pa.array(flat)), sizes)] if values else [packed(new[flat], sizes)]
        return pa.table([*[rows[c] for c in names], *extra.values(), *lists], names=[*names, *extra, result, *([values] if values else [])])

    kind = [StructField(result, ArrayType(LongType())), StructField(values, coded.schema["names"].dataType)] if values else [StructField(result, BinaryType())]
    schema = StructType([*[kinds[c] for c in [*names, *more]], *kind])
    return texts.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(of, schema)


# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
