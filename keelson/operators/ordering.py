"""Operators over a global row order that never put the whole table on one task.

A plain ``Window.orderBy(...)`` with no partition moves every row to a single task. Here the
order is cut into balanced range buckets instead:

1. bounds are taken from a sorted sample of the order keys and written into the plan as
   literals, so every task (and every retry) puts a row into the same bucket;
2. one shuffle by bucket, sorted by the keys, gives a per-bucket ``row_number``;
3. per-bucket row counts (one small number per bucket) turn that into a global index;
4. rows that a window needs from the *next* buckets (a "halo" of at most ``n-1`` rows per
   bucket) are gathered into a table of at most ``buckets x (n-1)`` rows and joined back.

Only the row index needs the counting pass; the other operators learn what they need about
buckets from their small side tables.

``sliding``, ``with_row_index`` and ``with_next`` append a hash of all columns to the order, so that
rows with equal keys have one order in every job and a hot key spreads over many buckets
(``tie_break=False`` leaves it out for an order that is total already); only rows equal in every
column stay together. ``gap_fill`` and the as-of join share this layout.
"""

from __future__ import annotations

import base64
import decimal
import json
import math
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.scalar import hashable, hashable_columns
from keelson.functions.scalar import ntz_epoch_micros
from keelson.session import shuffle_partitions, small_side

BUCKET = "_kl_bucket"
LOCAL_RN = "_kl_lrn"
GLOBAL_RN = "_kl_rn"

# Parameters, each with a session conf that overrides it. Key tuples sampled to place bucket bounds
# (the driver sorts about twice this many): more give evener buckets.
MAX_SAMPLE = 500_000
MAX_SAMPLE_CONF = "keelson.maxSample"
# Unless the caller fixes the bucket count, buckets hold about this many rows (session conf
# ``keelson.rowsPerBucket`` overrides), and never fewer buckets than shuffle partitions.
ROWS_PER_BUCKET = 2_000_000
ROWS_PER_BUCKET_CONF = "keelson.rowsPerBucket"
# The automatic bucket count stops here, since bounds are literals in the plan; beyond it buckets
# hold more rows, which the sort and window operators spill.
MAX_AUTO_BUCKETS = 100_000
MAX_AUTO_BUCKETS_CONF = "keelson.maxBuckets"


def _cols(cols) -> list[Column]:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _comparable(col: Column, dtype: T.DataType) -> Column:
    """An order-preserving, literal-friendly image of a key column (used for bucketing only)."""
    if isinstance(dtype, T.TimestampNTZType):
        return ntz_epoch_micros(col)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.DateType):
        return F.unix_date(col)
    if isinstance(dtype, T.BooleanType):
        return col.cast("int")
    if isinstance(dtype, (T.NumericType, T.StringType, T.BinaryType)):
        return col
    raise TypeError(f"order key of type {dtype.simpleString()} is not supported for range bucketing")


def _key_struct(cols: list[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


@dataclass
class OrderLayout:
    """Range buckets of a global order: bound tuples (as literals) and rows per bucket."""

    bounds: list[tuple]
    types: list[T.DataType]
    key_exprs: list[Column]
    counts: list[int] = field(default_factory=list)

    @property
    def num_buckets(self) -> int:
        return len(self.bounds) + 1

    @property
    def offsets(self) -> list[int]:
        out, acc = [], 0
        for c in self.counts:
            out.append(acc)
            acc += c
        return out

    def _image_plan(self) -> tuple[int, tuple, bytes]:
        """The key position ``m`` the numeric image is taken from (the first one where bounds
        differ), the bounds' common values before it, and for a string key the bytes all bounds
        share at its start (skipped by the image)."""
        width = len(self.types)
        m = 0
        while m < width - 1 and len({_order_key((b[m],)) for b in self.bounds}) == 1:
            m += 1
        const = tuple(self.bounds[0][:m])
        prefix = b""
        if isinstance(self.types[m], (T.StringType, T.BinaryType)):
            raws = [_raw_bytes(b[m]) for b in self.bounds if b[m] is not None]
            if raws:
                prefix = raws[0]
                for r in raws[1:]:
                    j = 0
                    while j < min(len(prefix), len(r)) and prefix[j] == r[j]:
                        j += 1
                    prefix = prefix[:j]
        return m, const, prefix

    def _hot_group(self, groups, m):
        """The largest group of at least 4 bounds that share one exact value at key ``m`` and
        have distinct images at key ``m+1``: (group index, value as JSON, images, prefix)."""
        if m + 1 >= len(self.types):
            return None
        best = None
        for gi, (_, start, length) in enumerate(groups):
            if length < 4 or (best is not None and length <= groups[best[0]][2]):
                continue
            members = self.bounds[start:start + length]
            if len({_order_key((b[m],)) for b in members}) != 1:
                continue
            prefix2 = b""
            if isinstance(self.types[m + 1], (T.StringType, T.BinaryType)):
                raws = [_raw_bytes(b[m + 1]) for b in members if b[m + 1] is not None]
                if raws:
                    prefix2 = raws[0]
                    for r in raws[1:]:
                        k = 0
                        while k < min(len(prefix2), len(r)) and prefix2[k] == r[k]:
                            k += 1
                        prefix2 = prefix2[:k]
            images2 = [_image_value(b[m + 1], self.types[m + 1], prefix2) for b in members]
            if any(a >= b for a, b in zip(images2, images2[1:])):
                continue  # equal images at the next key: leave it to the general search
            best = (gi, json.dumps({"v": _jsonable(members[0][m])}), images2, prefix2)
        return best

    def add_bucket(self, df: DataFrame, name: str = BUCKET) -> DataFrame:
        """Add the bucket id: the number of bounds <= the row's key tuple.

        A JVM binary search (``Bucketizer``) over a monotone numeric image of the first key does
        almost all the work; only rows whose image equals the image of some bound (a hot first
        key, or a collision) run a short binary search over that bound group's full tuples. The
        bounds and per-group tables are single literals, so the plan stays small for any number
        of buckets.
        """
        if not self.bounds:
            return df.withColumn(name, F.lit(0))
        m, const, prefix = self._image_plan()
        images = [_image_value(b[m], self.types[m], prefix) for b in self.bounds]
        groups: list[tuple[float, int, int]] = []  # (image, start, length)
        for i, v in enumerate(images):
            if groups and groups[-1][0] == v:
                groups[-1] = (v, groups[-1][1], groups[-1][2] + 1)
            else:
                groups.append((v, i, 1))
        u = [g[0] for g in groups]
        le_cum = [0]
        for g in groups:
            le_cum.append(le_cum[-1] + g[2])
        # the key tuple is computed once as a column; every branch below refers to it
        key = F.col("_kl_key")
        key_type = T.StructType([T.StructField(f"k{i}", t, True) for i, t in enumerate(self.types)])
        bounds_arr = _json_array([{f"k{i}": _jsonable(v) for i, v in enumerate(b)} for b in self.bounds],
                                 key_type)
        u_arr = _json_array(u, T.DoubleType())
        le_arr = _lit_array(le_cum, "int")
        start_arr = _lit_array([g[1] for g in groups], "int")
        len_arr = _lit_array([g[2] for g in groups], "int")
        max_len = max(g[2] for g in groups)
        img_col, j_col = "_kl_img", "_kl_j"
        splits = [float("-inf")] + u + [float("inf")]
        staged = df.withColumn("_kl_key", _key_struct(self.key_exprs))
        image = _image(key[f"k{m}"], self.types[m], prefix)
        lead_ok = F.lit(True)
        if m > 0:
            # rows whose leading keys differ from the bounds' common leading keys sort wholly
            # below or above every bound
            lead = F.struct(*[key[f"k{i}"].alias(f"k{i}") for i in range(m)])
            lead_type = T.StructType([T.StructField(f"k{i}", self.types[i], True) for i in range(m)])
            c = F.from_json(F.lit(json.dumps({f"k{i}": _jsonable(v) for i, v in enumerate(const)})), lead_type,
                            {"allowNonNumericNumbers": "true"})
            lead_ok = lead.eqNullSafe(c)
            image = F.when(lead_ok, image).when(lead < c, F.lit(-_IMG_MAX)).otherwise(F.lit(_IMG_MAX))
        staged = staged.withColumn(img_col, image)
        staged = Bucketizer(splits=splits, inputCol=img_col, outputCol=j_col).transform(staged)
        j = F.col(j_col).cast("int")
        g = j - 1
        hit = (j >= 1) & (F.col(img_col) == F.get(u_arr, g))
        start, length = F.get(start_arr, g), F.get(len_arr, g)
        if max_len == 1:
            refine = (key >= F.get(bounds_arr, start)).cast("int")
        else:
            steps = max(1, math.ceil(math.log2(max_len + 1)))

            def step(acc, _):
                mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
                return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
                    F.when(key < F.get(bounds_arr, mid), F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
                    .otherwise(F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))))

            search = F.aggregate(F.sequence(F.lit(1), F.lit(steps)),
                                 F.struct(start.alias("lo"), (start + length).alias("hi")), step)
            refine = F.when(length == 1, (key >= F.get(bounds_arr, start)).cast("int")) \
                .otherwise(search["lo"] - start)
        bucket = F.when(hit, F.get(le_arr, g) + refine).otherwise(F.get(le_arr, j))
        hot = self._hot_group(groups, m)
        if hot is not None:
            # the largest hot group (bounds sharing one exact key value) gets a JVM binary search
            # over the next key position instead of the interpreted one
            gi, v_json, images2, prefix2 = hot
            v_start, v_len = groups[gi][1], groups[gi][2]
            img2_col, j2_col = "_kl_img2", "_kl_j2"
            staged = staged.withColumn(img2_col, _image(key[f"k{m + 1}"], self.types[m + 1], prefix2))
            staged = Bucketizer(splits=[float("-inf")] + images2 + [float("inf")], inputCol=img2_col,
                                outputCol=j2_col).transform(staged)
            vcol = F.from_json(F.lit(v_json), T.StructType([T.StructField("v", self.types[m], True)]),
                               {"allowNonNumericNumbers": "true"})["v"]
            j2 = F.col(j2_col).cast("int")
            i2 = F.lit(v_start) + j2 - 1  # the bound whose next-key image is the largest <= the row's
            exact2 = (j2 >= 1) & (F.col(img2_col) == F.get(_json_array(images2, T.DoubleType()), j2 - 1))
            in_hot = hit & lead_ok & (g == F.lit(gi)) & key[f"k{m}"].eqNullSafe(vcol)
            count2 = F.when(exact2, j2 - 1 + (key >= F.get(bounds_arr, i2)).cast("int")).otherwise(j2)
            bucket = F.when(in_hot, F.lit(le_cum[gi]) + count2).otherwise(bucket)
            drop_extra = [img2_col, j2_col]
        else:
            drop_extra = []
        # never null; typing it non-nullable keeps Catalyst from inferring isnotnull filters on
        # joins by bucket and pushing the whole bucket expression into scans
        return (staged.withColumn(name, F.coalesce(bucket.cast("int"), F.lit(0)))
                .drop(img_col, j_col, "_kl_key", *drop_extra))


# Images of first keys are clamped to finite doubles; +-inf, NaN and null collide at the ends
# and are told apart by the full-tuple refinement.
_IMG_MAX = 1.7e308


def _raw_bytes(v) -> bytes:
    return v.encode("utf-8") if isinstance(v, str) else bytes(v)


# Images of strings that do not start with the bounds' common prefix sort wholly below or above.
_IMG_BELOW, _IMG_ABOVE = -1.0, 2.0 ** 49


def _image(col: Column, dtype: T.DataType, prefix: bytes = b"") -> Column:
    """Monotone non-decreasing double image of a (comparable) key column, null first."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        raw = col.cast("binary") if isinstance(dtype, T.StringType) else col
        n = len(prefix)
        tail = F.conv(F.rpad(F.hex(F.substring(raw, n + 1, 6)), 12, "0"), 16, 10).cast("double")
        if n:
            p = F.unhex(F.lit(prefix.hex()))
            d = (F.when(F.substring(raw, 1, n) == p, tail)
                 .when(raw < p, F.lit(_IMG_BELOW)).otherwise(F.lit(_IMG_ABOVE)))
            d = F.when(raw.isNull(), F.lit(None).cast("double")).otherwise(d)
        else:
            d = tail
    else:
        # + 0.0 turns -0.0 into 0.0: Spark orders them equal, a binary search over doubles does not
        d = col.cast("double") + F.lit(0.0)
    return (F.when(d.isNull(), F.lit(-_IMG_MAX))
            .when(F.isnan(d) | (d >= _IMG_MAX), F.lit(_IMG_MAX))
            .when(d <= -_IMG_MAX, F.lit(-_IMG_MAX))
            .otherwise(d))


def _image_value(v, dtype: T.DataType, prefix: bytes = b"") -> float:
    """The same image computed on the driver for a bound value."""
    if v is None:
        return -_IMG_MAX
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        raw = _raw_bytes(v)
        n = len(prefix)
        if raw[:n] == prefix:
            d = float(int.from_bytes(raw[n:n + 6].ljust(6, b"\0"), "big"))
        elif raw < prefix:
            d = _IMG_BELOW
        else:
            d = _IMG_ABOVE
    else:
        d = float(v) + 0.0
    if d != d or d >= _IMG_MAX:
        return _IMG_MAX
    if d <= -_IMG_MAX:
        return -_IMG_MAX
    return d


def _jsonable(v):
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode("ascii")
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v


def _json_array(values: list, element: T.DataType) -> Column:
    """A constant array as one folded literal (``from_json`` over a string literal), instead of
    one expression per element."""
    return F.from_json(F.lit(json.dumps(values)), T.ArrayType(element), {"allowNonNumericNumbers": "true"})


def _lit_array(values: list[int], dtype: str = "bigint") -> Column:
    t = {"bigint": T.LongType(), "int": T.IntegerType()}[dtype]
    return _json_array([int(v) for v in values], t)


def _order_key(row: tuple) -> tuple:
    """Python sort key equal to Spark's ascending order: nulls first, NaN above all numbers."""
    out = []
    for v in row:
        if v is None:
            out.append((0, 0, 0))
        elif isinstance(v, float) and v != v:
            out.append((1, 1, 0))
        else:
            out.append((1, 0, v))
    return tuple(out)


def _sample(kdf: DataFrame, rows: int, target: int, seed: int) -> list[tuple]:
    """A Bernoulli sample of about twice ``target`` of ``rows`` key tuples, or all if they are no
    more, drawn without Python on the executors."""
    picked = kdf if rows <= 2 * target else kdf.sample(fraction=min(1.0, 2 * target / rows), seed=seed)
    return [tuple(r) for r in picked.collect()]


def _even_bounds(sample: list[tuple], n: int) -> list[tuple]:
    """Up to ``n-1`` distinct bound tuples splitting the sample into equal shares."""
    sample = sorted(sample, key=_order_key)
    bounds: list[tuple] = []
    for i in range(1, n):
        at = -(-i * len(sample) // n)
        if at < len(sample) and (not bounds or _order_key(bounds[-1]) < _order_key(sample[at])):
            bounds.append(sample[at])
    return bounds


def plan_layout(df: DataFrame, keys, num_buckets: int | None = None,
                sample_per_bucket: int = 50, seed: int = 7, count: bool = True) -> OrderLayout:
    """Count and sample the keys, fix bucket bounds, then (unless ``count=False``) count rows per bucket.

    Small jobs over the key columns: a row count, a sample of about ``num_buckets *
    sample_per_bucket`` key tuples, and one count per bucket. Their results are bounded by the
    bucket count, not the data.
    """
    keys = _cols(keys)
    spark = df.sparkSession
    n = max(1, int(num_buckets or shuffle_partitions(spark)))
    typed = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    comp = [_comparable(F.col(f.name), f.dataType) for f in typed.schema.fields]
    comp_schema = typed.select(*[c.alias(f"k{i}") for i, c in enumerate(comp)]).schema
    types = [f.dataType for f in comp_schema.fields]
    key_exprs = [_comparable(k, f.dataType) for k, f in zip(keys, typed.schema.fields)]

    bounds: list[tuple] = []
    if n > 1 or num_buckets is None:
        kdf = typed.select(*[c.alias(f"k{i}") for i, c in enumerate(comp)])
        rows = kdf.count()  # a plain Parquet scan answers this from its footers
        if num_buckets is None:  # at least one bucket per shuffle partition, more for more rows
            per_bucket = int(spark.conf.get(ROWS_PER_BUCKET_CONF, str(ROWS_PER_BUCKET)))
            most = int(spark.conf.get(MAX_AUTO_BUCKETS_CONF, str(MAX_AUTO_BUCKETS)))
            n = max(n, min(most, -(-rows // max(1, per_bucket))))
        if n > 1:
            most = int(spark.conf.get(MAX_SAMPLE_CONF, str(MAX_SAMPLE)))
            bounds = _even_bounds(_sample(kdf, rows, min(n * sample_per_bucket, most), seed), n)
    layout = OrderLayout(bounds=bounds, types=types, key_exprs=key_exprs)
    if count:
        count_buckets(df, layout)
    return layout


def count_buckets(df: DataFrame, layout: OrderLayout) -> OrderLayout:
    """One pass: rows per bucket, one small number per bucket."""
    counts = [0] * layout.num_buckets
    for r in layout.add_bucket(df).groupBy(BUCKET).count().collect():
        counts[r[0]] = r[1]
    layout.counts = counts
    return layout


def rank_rows(df: DataFrame, keys, layout: OrderLayout | None = None,
              num_buckets: int | None = None) -> tuple[DataFrame, OrderLayout]:
    """Add the bucket id, the row number inside the bucket and the global 1-based row number."""
    keys = _cols(keys)
    layout = layout or plan_layout(df, keys, num_buckets)
    if len(layout.counts) != layout.num_buckets:
        count_buckets(df, layout)  # a layout planned without counts: offsets need them
    w = Window.partitionBy(BUCKET).orderBy(*keys)
    ranked = (
        layout.add_bucket(df)
        .withColumn(LOCAL_RN, F.row_number().over(w).cast("bigint"))
        .withColumn(GLOBAL_RN, F.get(_lit_array(layout.offsets), F.col(BUCKET)) + F.col(LOCAL_RN))
    )
    return ranked, layout


def _total_order(df: DataFrame, keys: list[Column], tie_break: bool) -> list[Column]:
    """The keys and, last, a hash of all columns that can be hashed: rows with equal keys then have
    the same order in every job."""
    names = hashable_columns(df)
    return [*keys, F.xxhash64(*names)] if tie_break and names else keys


def with_row_index(df: DataFrame, order, name: str = "row_index", num_buckets: int | None = None,
                   layout: OrderLayout | None = None, tie_break: bool = True) -> DataFrame:
    """1-based row number in a global order, without a single-partition window."""
    ranked, _ = rank_rows(df, _total_order(df, _cols(order), tie_break), layout, num_buckets)
    return ranked.withColumn(name, F.col(GLOBAL_RN)).drop(BUCKET, LOCAL_RN, GLOBAL_RN)


def _sources(counts: list[int]) -> list[int]:
    """For every bucket, the nearest earlier bucket with a non-zero count (-1 if none)."""
    out, last = [], -1
    for c, cnt in enumerate(counts):
        out.append(last)
        if cnt > 0:
            last = c
    return out


def fill_forward(df: DataFrame, cols, order, partition_by=None, suffix: str = "_ff",
                 num_buckets: int | None = None) -> DataFrame:
    """For each column, add ``<col><suffix>``: its last non-null value at or before the row in
    ``order`` within ``partition_by`` (``last(ignorenulls)`` over a running frame), without a
    single-partition window. Inside a bucket a running window does it; the last value of earlier
    buckets comes from a table of at most one row per bucket."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    part_names = _names(partition_by, df)
    parts = _cols(part_names)
    order = _cols(order)
    keys = parts + order
    layout = plan_layout(df, keys, num_buckets, count=False)
    b = layout.add_bucket(df)
    w = (Window.partitionBy(BUCKET, *parts).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = b.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_kl_in{i}") for i, c in enumerate(cols)])
    order_struct = _key_struct(keys)
    any_value = F.lit(False)
    for c in cols:
        any_value = any_value | F.col(c).isNotNull()
    # only rows holding a value can be carried (for the dump scan: header lines only)
    carry = b.where(any_value).groupBy(F.col(BUCKET).alias("_kl_cb")).agg(*[
        F.max_by(F.when(F.col(c).isNotNull(),
                        F.struct(*[F.col(p).alias(f"p{j}") for j, p in enumerate(part_names)], F.col(c).alias("v"))),
                 F.when(F.col(c).isNotNull(), order_struct)).alias(f"_kl_last{i}")
        for i, c in enumerate(cols)])
    carry = small_side(carry, layout.num_buckets)  # at most one row per bucket
    # which buckets hold a value of each column: read back from the small table just written
    present = carry.select("_kl_cb", *[F.col(f"_kl_last{i}").isNotNull() for i in range(len(cols))]).collect()
    for i, c in enumerate(cols):
        has = [0] * layout.num_buckets
        for r in present:
            if r[1 + i]:
                has[r[0]] = 1
        src = _lit_array(_sources(has), "int")
        side = carry.select(F.col("_kl_cb").alias(f"_kl_cb{i}"), F.col(f"_kl_last{i}").alias(f"_kl_carry{i}"))
        out = out.join(side, F.coalesce(F.get(src, F.col(BUCKET)), F.lit(-1)) == F.col(f"_kl_cb{i}"), "left")
        carried = F.col(f"_kl_carry{i}")
        same = F.lit(True)
        for j, p in enumerate(part_names):
            same = same & carried[f"p{j}"].eqNullSafe(F.col(p))
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"_kl_in{i}"), F.when(same, carried["v"])))
        out = out.drop(f"_kl_cb{i}", f"_kl_carry{i}", f"_kl_in{i}")
    return out.drop(BUCKET)


def _first_rows(bucketed: DataFrame, layout: OrderLayout, keys: list[Column], payload: Column) -> DataFrame:
    """For every bucket, the first row of the next non-empty bucket (the halo of ``n = 2``).

    Each bound is a sampled key tuple and the smallest key of its bucket, so the first row of
    bucket ``c`` is the row whose key equals bound ``c-1``: a map-side join against the bound
    table (no sort, no shuffle of the data). If some bound is not found again (an input that is
    not deterministic), the first rows come from ``min_by`` per bucket instead.
    """
    if layout.bounds:
        spark = bucketed.sparkSession
        key_type = T.StructType([T.StructField(f"k{i}", t, True) for i, t in enumerate(layout.types)])
        text = json.dumps([{f"k{i}": _jsonable(v) for i, v in enumerate(b)} for b in layout.bounds])
        bound_rows = spark.range(1).select(
            F.posexplode(F.from_json(F.lit(text), T.ArrayType(key_type), {"allowNonNumericNumbers": "true"}))
            .alias("_kl_i", "_kl_b")).select((F.col("_kl_i") + 1).cast("int").alias("_kl_fb"), "_kl_b")
        probe = bucketed.select(_key_struct(layout.key_exprs).alias("_kl_key"), payload.alias("_kl_first"))
        found = probe.join(bound_rows, F.col("_kl_key").eqNullSafe(F.col("_kl_b")))
        # ties on the full key are interchangeable; keep one row per bucket, chosen by content
        first = small_side(found.groupBy("_kl_fb").agg(
            F.min_by("_kl_first", F.xxhash64(*hashable(F.col("_kl_first"), probe.schema["_kl_first"].dataType))).alias("_kl_first")), layout.num_buckets)
        if first.count() == len(layout.bounds):
            # every bucket after the first holds its bound's row, so it is non-empty
            return first.select((F.col("_kl_fb") - 1).alias(BUCKET), F.col("_kl_first").alias("_kl_follow"))
    first = small_side(bucketed.groupBy(F.col(BUCKET).alias("_kl_fb"))
                       .agg(F.min_by(payload, _key_struct(keys)).alias("_kl_first")), layout.num_buckets)
    present = [0] * layout.num_buckets
    for r in first.select("_kl_fb").collect():
        present[r[0]] = 1
    prev = _sources(present)
    # a bucket with no earlier non-empty bucket maps to -1 and simply never joins
    return first.select(F.coalesce(F.get(_lit_array(prev, "int"), F.col("_kl_fb")), F.lit(-1)).alias(BUCKET),
                        F.col("_kl_first").alias("_kl_follow"))


def _heads_follow(bucketed: DataFrame, layout: OrderLayout, keys: list[Column], n: int,
                  row: Column) -> DataFrame:
    """For every bucket, the first ``n-1`` rows after it in the global order.

    Each bucket's first ``n-1`` rows (its head) are materialized once, at most
    ``buckets x (n-1)`` rows. Concatenating heads in bucket order gives the rows that follow any
    bucket: a bucket with fewer rows than that contributes all of them. Head sizes, read back
    from the small table, say which earlier buckets each head row reaches.
    """
    k = n - 1
    w = Window.partitionBy(BUCKET).orderBy(*keys)
    heads = small_side(
        bucketed.withColumn(LOCAL_RN, F.row_number().over(w)).where(F.col(LOCAL_RN) <= k)
        .select(F.col(BUCKET).alias("_kl_hb"), F.col(LOCAL_RN).alias("_kl_hr"), row.alias("row")),
        layout.num_buckets * k)
    sizes = [0] * layout.num_buckets
    for r in heads.groupBy("_kl_hb").count().collect():
        sizes[r[0]] = r[1]
    prefix = [0]
    for c in sizes:
        prefix.append(prefix[-1] + c)
    # lowest target bucket a head row of bucket c can reach: rows strictly between must be < k
    lo, j = [], 0
    for c in range(layout.num_buckets):
        while j < c and prefix[c] - prefix[j + 1] >= k:
            j += 1
        lo.append(j)
    p_arr, lo_arr = _lit_array(prefix), _lit_array(lo, "int")
    c, r = F.col("_kl_hb"), F.col("_kl_hr")
    lo_c = F.get(lo_arr, c)
    targets = F.when(
        lo_c <= c - 1,
        F.filter(F.sequence(lo_c, c - 1),
                 lambda b: F.get(p_arr, c) - F.get(p_arr, b + 1) + r <= F.lit(k)),
    ).otherwise(F.array().cast("array<int>"))
    spread = heads.select(F.explode(targets).alias(BUCKET), F.struct(c.alias("c"), r.alias("r")).alias("o"), "row")
    by_order = F.array_sort(
        F.collect_list(F.struct("o", "row")),
        lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0),
    )
    # assembled in its own small job, so the main plan keeps a single shuffle of the data
    return small_side(spread.groupBy(BUCKET).agg(F.transform(by_order, lambda x: x["row"]).alias("_kl_follow")),
                      layout.num_buckets)


def sliding(df: DataFrame, n: int, order, partition_by=None, name: str = "window",
            keep_columns: bool = False, num_buckets: int | None = None, tie_break: bool = True) -> DataFrame:
    """For every row, the array of it and the next ``n-1`` rows in order (whole-row structs).

    One output row per input row; the last ``n-1`` arrays are shorter. With ``partition_by`` the
    window stops at the partition's end. Hot partitions are split across buckets like any key.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    part_names = _names(partition_by, df)
    parts = _cols(part_names)
    keys = parts + _cols(order)
    if not keys:
        raise ValueError("sliding needs at least one order column")
    keys = _total_order(df, keys, tie_break)
    src_cols = list(df.columns)
    layout = plan_layout(df, keys, num_buckets, count=False)  # no global row numbers needed
    bucketed = layout.add_bucket(df)
    row = F.struct(*[F.col(c) for c in src_cols])
    w = Window.partitionBy(BUCKET).orderBy(*keys)
    main = bucketed.withColumn("_kl_win", F.collect_list(row).over(w.rowsBetween(0, n - 1)))
    win = F.col("_kl_win")
    if n == 2:
        # one following row: the per-bucket first rows suffice (no head window)
        main = main.join(_first_rows(bucketed, layout, keys, row), BUCKET, "left")
        nxt = F.when(F.col("_kl_follow").isNotNull(), F.array(F.col("_kl_follow"))).otherwise(F.slice(win, 1, 0))
        win = F.slice(F.concat(win, nxt), 1, n)
    elif n > 2:
        follow = _heads_follow(bucketed, layout, keys, n, row)
        main = main.join(follow, BUCKET, "left")
        win = F.slice(F.concat(win, F.coalesce(F.col("_kl_follow"), F.slice(win, 1, 0))), 1, n)
    if parts:
        win = F.filter(win, lambda x: _all_eq([x[p].eqNullSafe(F.col(p)) for p in part_names]))
    keep = [F.col(c) for c in src_cols] if keep_columns else []
    return main.select(*keep, win.alias(name))


def _names(cols, df: DataFrame) -> list[str]:
    if cols is None:
        return []
    names = [cols] if isinstance(cols, str) else list(cols)
    for c in names:
        if not isinstance(c, str) or c not in df.columns:
            raise ValueError(f"partition_by must name columns of the input, got {c!r}")
    return names


def _all_eq(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def with_next(df: DataFrame, order, next_cols=None, name: str = "next", partition_by=None,
              num_buckets: int | None = None, tie_break: bool = True) -> DataFrame:
    """Attach the next row in order as a struct (null for the last row of a partition).

    This is the reference's self join ``current.rowNum = next.rowNum - 1`` without a join:
    ``lead`` inside a bucket, and the first row of the following bucket at bucket ends.
    """
    part_names = _names(partition_by, df)
    keys = _total_order(df, _cols(part_names) + _cols(order), tie_break)
    src_cols = list(df.columns)
    carry = list(next_cols) if next_cols else list(src_cols)
    carry += [p for p in part_names if p not in carry]
    layout = plan_layout(df, keys, num_buckets, count=False)  # no global row numbers needed
    bucketed = layout.add_bucket(df)
    payload = F.struct(*[F.col(c) for c in carry])
    w = Window.partitionBy(BUCKET).orderBy(*keys)
    main = bucketed.withColumn("_kl_lead", F.lead(payload).over(w))
    follow = _first_rows(bucketed, layout, keys, payload)
    main = main.join(follow, BUCKET, "left")
    nxt = F.coalesce(F.col("_kl_lead"), F.col("_kl_follow"))
    if part_names:
        nxt = F.when(_all_eq([nxt[p].eqNullSafe(F.col(p)) for p in part_names]), nxt)
    return main.select(*[F.col(c) for c in src_cols], nxt.alias(name))


def gap_fill(df: DataFrame, input_col: str, output_col: str, max_gap: int,
             tiebreak=None, num_buckets: int | None = None) -> DataFrame:
    """Integer gap fill over the global order of ``input_col``.

    With ``d = next - current`` (bigint): a row whose next key is missing, farther than
    ``max_gap`` or equal is emitted once with offset 0; otherwise it is emitted ``d`` times with
    offsets ``0 .. d-1``. ``max_gap`` bounds the growth per row.
    """
    check_gap_fill_schema(df.schema, input_col, output_col)
    order = [F.col(input_col)] + (_cols(tiebreak) if tiebreak is not None else [])
    nxt = with_next(df, order, next_cols=[input_col], name="_kl_next", num_buckets=num_buckets)
    # null past the bigint range: such a gap is too far, like a missing next key
    d = F.try_subtract(F.col(f"_kl_next.{input_col}").cast("bigint"), F.col(input_col).cast("bigint"))
    offsets = F.when(d.isNull() | (d > F.lit(max_gap)) | (d <= 0), F.array(F.lit(0).cast("bigint"))) \
        .otherwise(F.sequence(F.lit(0).cast("bigint"), d - 1))
    return nxt.select(*[F.col(c) for c in df.columns], F.explode(offsets).alias(output_col))


def check_gap_fill_schema(schema: T.StructType, input_col: str, output_col: str) -> T.StructType:
    """Key must be short, int or long; output name must be new; output type is long."""
    if input_col not in schema.fieldNames():
        raise ValueError(f"input column {input_col!r} not found")
    if output_col in schema.fieldNames():
        raise ValueError(f"output column {output_col!r} already exists")
    dtype = schema[input_col].dataType
    if not isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        raise ValueError(f"invalid input type {dtype.simpleString()}; valid types are smallint, int, bigint")
    return T.StructType(schema.fields + [T.StructField(output_col, T.LongType(), True)])


# Fixed value: the default maximum gap of the reference's event flow.
DEFAULT_MAX_GAP = 300


class GapFiller(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """W3 as an ML stage: ``inputCol`` (short, int or long), a new ``outputCol`` (long) and
    ``maxGap``. The schema rules (W3a) are checked before any job runs."""

    maxGap = Param(Params._dummy(), "maxGap", "maximum gap to fill", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None,
                 maxGap: int = DEFAULT_MAX_GAP):
        super().__init__()
        self._setDefault(maxGap=DEFAULT_MAX_GAP)
        self._set(**self._input_kwargs)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        return check_gap_fill_schema(schema, self.getInputCol(), self.getOutputCol())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return gap_fill(dataset, self.getInputCol(), self.getOutputCol(), self.getOrDefault(self.maxGap))
