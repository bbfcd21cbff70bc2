"""Scan of a game addon's saved-variables dump into event rows.

A dump assigns nested tables to globals, in any layout (tabs and one entry per line are usual)::

    <root> = {
        ["actionEvents"] = {
            [<spellId>] = {
                <epoch ms>, -- [1]
            },
        },
        ["damageEvents"] = {
            [<spellId>] = {
                [<epoch ms>] = <amount>,
            },
        },
    }

``actionEvents`` rows become ``(timestamp, action{spellId}, null)``; ``damageEvents`` rows become
``(timestamp, null, damage{spellId, amount})``. A damage time repeated within one spell, and an action with
a repeated explicit key, are one table key in the dump's language, so the last one wins; an entry set to ``nil`` is
none. Only the table named ``root`` is read; other globals, tables or plain values, may stand before
and after it.

Plan. Files are read with the splittable text reader; lines are cut into tokens (:mod:`dumplex`) and
staged once in the shared checkpoint folder, so every later pass sees the same splits whatever
executors come and go. What a split needs from the splits before it is carried over by small side
tables with one row per split:

1. the lexical state it begins in (inside a string or a comment), where some line could leave one open:
   each split's turning lines are folded into a map from state to state, the maps of a file one after another;
2. how many tables are open, by a running sum of brackets, and the last few tokens, as a key and
   its value may stand in different splits;
3. the keys of the tables that are open.

One shuffle by (file, split) resolves all three inside a split. A split is bounded by the reader; only
a compressed file that cannot be split, or a line of its own size, is larger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.session import ensure_checkpoint_dir, remove_at_exit, small_side
from keelson.sources import dumplex as lex

# The dump's global table name and its two sections.
DEFAULT_ROOT = "WTFTestAddonData"
ACTION_SECTION = "actionEvents"
DAMAGE_SECTION = "damageEvents"

# The fixed output schema, available without reading a file.
EVENT_DUMP_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("action", T.StructType([T.StructField("spellId", T.LongType(), False)]), True),
    T.StructField("damage", T.StructType([T.StructField("spellId", T.LongType(), False),
                                          T.StructField("amount", T.LongType(), False)]), True),
])
#: With ``numbers="variant"``: amounts that are whole are bigint inside, others double.
EVENT_DUMP_VARIANT_SCHEMA = T.StructType([
    *EVENT_DUMP_SCHEMA.fields[:2],
    T.StructField("damage", T.StructType([T.StructField("spellId", T.LongType(), False),
                                          T.StructField("amount", T.VariantType(), True)]), True),
])

_SPLIT = ["file", "block"]


def _whole(text: Column) -> Column:
    """A whole number as bigint; anything else null (flagged as an error by the caller)."""
    d = text.try_cast("double")
    as_long = text.try_cast("bigint")
    return F.when(as_long.isNotNull(), as_long).when(d.isNotNull() & (d == F.floor(d)), d.try_cast("bigint"))


def _number(text: Column) -> Column:
    """A number as a variant that holds a bigint if it is whole, else a double; null if it is none."""
    whole = _whole(text)
    return F.when(whole.isNotNull(), whole.cast("variant")).otherwise(text.try_cast("double").cast("variant"))


def _stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-dump-{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(lex.TOKEN), F.lit(0))


def _tokens(raw: Column) -> Column:
    """Without comments; texts that stay open are an empty string."""
    shown = F.filter(raw, lambda t: ~t.startswith("--"))
    return F.transform(shown, lambda t: F.when(t.rlike(lex.OPAQUE), F.lit('""')).otherwise(t))


def _rest(line: Column, state: str) -> Column:
    """What follows the end of the text or comment that the line begins in; null if it does not end here."""
    if state in lex.UNTIL_QUOTE:
        until = lex.UNTIL_QUOTE[state]
        return F.when(line.rlike(until), F.regexp_replace(line, until, ""))
    at = F.instr(line, state) if state else None
    return line if at is None else F.when(at > 0, F.substring(line, at + len(state), F.length(line)))


def _state_after(line: Column, state: str) -> Column:
    """The number of the state in which the line after ``line`` begins, if that begins in ``state``; 0 is none of ours."""
    rest = _rest(line, state)
    head = f"(?s)^{lex.OPEN_LONG[4:]}"

    def after(last: Column) -> Column:
        closer = F.concat(F.lit("]"), F.regexp_extract(last, head, 1), F.lit("]"))
        opened = F.when(last.rlike(head), F.when(F.call_function("instr", last, closer) == 0, F.array_position(_STATES(), closer)))
        for quote in lex.UNTIL_QUOTE:
            opened = opened.when(last.startswith(quote) & last.endswith("\\") & last.rlike(lex.OPAQUE), F.array_position(_STATES(), F.lit(quote)))
        return F.coalesce(opened, F.lit(1).cast("long"))

    last = F.coalesce(F.call_function("try_element_at", _raw_tokens(rest), F.lit(-1)), F.lit(""))
    kept = F.lit(lex.STATES.index(state) + 1)
    if state in lex.UNTIL_QUOTE:
        kept = F.when(line.endswith("\\"), kept).otherwise(F.lit(1))
    return F.when(rest.isNull(), kept).otherwise(F.get(F.transform(F.array(last), after), F.lit(0))).cast("int")


def _STATES() -> Column:
    return F.array(*[F.lit(s) for s in lex.STATES])


def _past(state: Column) -> Column:
    """The state after one or more lines that do not turn: a quoted text ends with its line."""
    return F.when(state.isin([lex.STATES.index(q) + 1 for q in lex.UNTIL_QUOTE]), F.lit(1)).otherwise(state)


def _lines(spark: SparkSession, path) -> DataFrame:
    """Every line by position with its tokens, staged. ``row`` grows by one from line to line of a split."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    read = _stage(lines.select("*", _tokens(_raw_tokens(F.col("line"))).alias("tokens"), F.col("line").rlike(lex.TURNS).alias("turns")), "lines")
    return read if read.where("turns").isEmpty() else _with_states(read)


def _with_states(read: DataFrame) -> DataFrame:
    """The same lines with the tokens that remain under the state in which each line really begins.

    A turning line maps every state to the one after it. The turning lines of a split compose to a map
    of the split, the maps of a file's splits, one after another, give the state each begins in, and
    a second walk gives that of each line. Only numbers of states are gathered, a few per turning line.
    """
    to = F.array(*[_state_after(F.col("line"), s) for s in lex.STATES])
    turning = read.where("turns").select(*_SPLIT, "row", to.alias("to"))
    splits = (read.groupBy(*_SPLIT).agg(F.min("row").alias("first"), F.max("row").alias("last"))
              .join(turning.groupBy(*_SPLIT).agg(F.sort_array(F.collect_list(F.struct("row", "to"))).alias("turning")), _SPLIT, "left")
              .withColumn("turning", F.coalesce("turning", F.array().cast("array<struct<row:bigint,to:array<int>>>"))))
    splits = small_side(splits, 100_000)
    through = lambda to, state: F.when(state == 0, state).otherwise(F.get(to, state - 1))

    def walk(state: Column) -> Column:
        """``(state, at, seen)`` after the turning lines of a split that begins in ``state``."""
        start = F.struct(state.alias("state"), F.col("first").alias("at"), F.array().cast("array<struct<row:bigint,state:int,after:int>>").alias("seen"))

        def step(acc, x):
            begins = F.when(x["row"] > acc["at"], _past(acc["state"])).otherwise(acc["state"])
            seen = F.struct(x["row"].alias("row"), begins.alias("state"), through(x["to"], begins).alias("after"))
            return F.struct(through(x["to"], begins).alias("state"), (x["row"] + 1).alias("at"), F.concat(acc["seen"], F.array(seen)).alias("seen"))

        return F.aggregate("turning", start, step)

    ended = lambda acc: F.when(acc["at"] <= F.col("last"), _past(acc["state"])).otherwise(acc["state"])
    maps = splits.select(*_SPLIT, F.transform(F.array(*[F.lit(n + 1) for n in range(len(lex.STATES))]), lambda n: ended(walk(n))).alias("to"))

    def follow(acc, x):
        begins = F.struct(x["block"].alias("block"), acc["state"].alias("state"))
        return F.struct(through(x["to"], acc["state"]).alias("state"), F.concat(acc["begins"], F.array(begins)).alias("begins"))

    none = F.struct(F.lit(1).alias("state"), F.array().cast("array<struct<block:bigint,state:int>>").alias("begins"))
    chains = maps.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "to"))).alias("maps"))
    begins = small_side(chains.select("file", F.inline(F.aggregate("maps", none, follow)["begins"])), 100_000)

    walked = splits.join(begins, _SPLIT)
    seen = walked.select(*_SPLIT, F.inline(walk(F.col("state"))["seen"]))
    marked = (read.join(seen, [*_SPLIT, "row"], "left")
              .join(walked.select(*_SPLIT, "first", F.col("state").alias("begin")), _SPLIT))
    before = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("prior", F.last(F.when(F.col("state").isNotNull(), F.struct("row", "after")), ignorenulls=True).over(before))
    state = (F.when(F.col("state").isNotNull(), F.col("state"))
             .when(F.col("prior").isNotNull(), F.when(F.col("prior.row") + 1 == F.col("row"), F.col("prior.after")).otherwise(_past(F.col("prior.after"))))
             .when(F.col("row") == F.col("first"), F.col("begin")).otherwise(_past(F.col("begin"))))
    marked = marked.select(*_SPLIT, "row", "line", "tokens", "turns", state.alias("state"))
    tokens = F.when(F.col("state") == 1, F.col("tokens"))
    for n, s in enumerate(lex.STATES[1:], 2):
        rest = _rest(F.col("line"), s)
        tokens = tokens.when(F.col("state") == n, F.when(rest.isNull(), F.array().cast("array<string>")).otherwise(_tokens(_raw_tokens(rest))))
    tokens = tokens.otherwise(F.raise_error(F.concat(F.lit("event dump: long bracket of too high a level before a line of "), "file")).cast("array<string>"))
    return _stage(marked.select(*_SPLIT, "row", "line", tokens.alias("tokens"), "turns"), "states")


#: Tokens before a value that its key may take: ``[ key ] =``, and the separator before them.
_LOOK_BACK = 6


def event_dump_entries(spark: SparkSession, path, root: str = DEFAULT_ROOT) -> DataFrame:
    """What stands inside the table ``root`` of every file: opened tables, entries and faults.

    One row each, at ``(file, block, row, i)``: ``kind`` (``open``, ``entry`` or ``fault``), ``key`` and ``value``
    as written (null key: by position), ``depth`` (tables open around it), ``section`` and ``spell``
    (keys of the second and third of these), and the line.
    """
    if not path:
        raise ValueError("Path is required")
    lines = _lines(spark, path)
    opens = lambda t: t.endswith("{") & ~t.startswith('"') & ~t.startswith("'")
    steps = F.size(F.filter("tokens", opens)) - F.size(F.filter("tokens", lambda t: t == "}"))
    sums = lines.groupBy(*_SPLIT).agg(F.sum(steps).alias("sum"))
    # the last tokens of each split, from its last lines that have any
    backward = Window.partitionBy(*_SPLIT).orderBy(F.col("row").desc())
    ends = (lines.where(F.size("tokens") > 0).withColumn("n", F.row_number().over(backward)).where(F.col("n") <= _LOOK_BACK)
            .groupBy(*_SPLIT).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row", "tokens"))), lambda x: x["tokens"])).alias("tail")))
    tail = F.slice("tail", F.greatest(F.size("tail") - (_LOOK_BACK - 1), F.lit(1)), _LOOK_BACK)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("file").orderBy("block").rowsBetween(-_LOOK_BACK, 0)
    # of the splits that have tokens, each with the last tokens up to its end
    tails = ends.withColumn("tail", tail).withColumn("upto", F.flatten(F.collect_list("tail").over(near)))
    tails = tails.select(*_SPLIT, F.slice("upto", F.greatest(F.size("upto") - (_LOOK_BACK - 1), F.lit(1)), _LOOK_BACK).alias("upto"))
    side = sums.join(tails, _SPLIT, "left").select(
        *_SPLIT, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.last("upto", ignorenulls=True).over(before), F.array().cast("array<string>")).alias("held"))
    side = small_side(side, 100_000)

    shown = lines.select(*_SPLIT, "row", "line", F.posexplode("tokens").alias("i", "t"))
    shown = shown.unionByName(side.select(*_SPLIT, F.lit(-1).cast("bigint").alias("row"), F.lit(None).cast("string").alias("line"),
                                          F.posexplode("held").alias("i", "t")))
    order = Window.partitionBy(*_SPLIT).orderBy("row", "i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t, p = F.col("t"), [F.col("t"), *[F.col(f"p{k}") for k in range(1, _LOOK_BACK)]]
    own = F.col("row") >= 0
    step = F.when(~own, 0).when(opens(t), 1).when(t == "}", -1).otherwise(0)
    shown = (shown.withColumns({f"p{k}": F.lag("t", k).over(order) for k in range(1, _LOOK_BACK)})
             .withColumn("at", F.sum(step).over(upto) - step)
             .join(side.select(*_SPLIT, "base"), _SPLIT).withColumn("depth", (F.col("base") + F.col("at")).cast("int")))

    def is_name(x: Column) -> Column:
        return x.rlike(f"^{lex.NAME}\\Z")

    def key_before(eq: int) -> Column:
        """The key whose ``=`` stands ``eq`` tokens back."""
        bracketed = (p[eq + 1] == "]") & (p[eq + 3] == "[")
        return F.when(p[eq] == "=", F.when(bracketed, p[eq + 2]).when(is_name(p[eq + 1]) & ~F.coalesce(p[eq + 2] == ".", F.lit(False)), p[eq + 1]))

    def one_of(x: Column, *ends: str) -> Column:
        """True if ``x`` ends in one of these and is no text."""
        return ~x.rlike("^[\"']") & F.substring(x, -1, 1).isin(*ends)

    scalar = lambda x: x.rlike(f"(?s)^(?:{lex.NUMBER}|{lex.NAME}|{lex.STRING})\\Z")
    is_entry, is_item = t.rlike(f"^{lex.ENTRY[4:]}\\Z"), t.rlike(f"^{lex.ITEM}\\Z")
    is_open, ends_value = opens(t), t.isin(",", ";", "}")
    after_value = ends_value & F.coalesce(scalar(p[1]), F.lit(False))
    starts = F.coalesce(one_of(p[1], "{", ",", ";"), F.lit(True))
    has_key = F.coalesce(p[1] == "=", F.lit(False))
    fault = (F.when(is_entry | (is_open & (t != "{")), ~starts)
             .when(is_item | is_open, ~starts & ~has_key)
             .when(t == "}", F.coalesce(p[1].isin("=", "[", "]"), F.lit(False)))
             .when(ends_value, ~(after_value | F.coalesce(p[1] == "}", F.lit(False))))
             .when(t == "=", ~F.coalesce((p[1] == "]") | is_name(p[1]), F.lit(False)))
             .when(t == "[", ~starts).when(t == "]", ~F.coalesce(p[2] == "[", F.lit(False)))
             .when(scalar(t), ~starts & ~has_key & ~F.coalesce(p[1] == "[", F.lit(False)))
             .otherwise(True))
    kind = F.when(fault, "fault").when(is_open, "open").when(is_entry | is_item | after_value, "entry")
    key = (F.when(is_entry, F.regexp_extract(t, lex.ENTRY, 1)).when(is_open & (t != "{"), F.regexp_extract(t, lex.OPEN_KEYED, 1))
           .when(is_open | is_item, key_before(1)).when(after_value, key_before(2)))
    value = F.when(is_entry, F.regexp_extract(t, lex.ENTRY, 2)).when(is_item, F.regexp_extract(t, lex.ITEM, 1)).when(after_value, p[1])
    plain = lambda k: F.when(k.rlike("^[\"']"), F.expr("substring(key, 2, length(key) - 2)")).otherwise(k)
    found = shown.withColumns({"kind": kind, "key": key, "value": value}).withColumn("key", plain(F.col("key")))
    heads = {f"h{d}": F.last(F.when(own & (F.col("kind") == "open") & (F.col("depth") == d), F.struct("key")), ignorenulls=True).over(upto)
             for d in range(3)}
    found = _stage(found.withColumns(heads).where(own & F.col("kind").isNotNull())
                   .select(*_SPLIT, "row", "i", "kind", "key", "value", "depth", *heads, "line"), "entries")

    # the keys in force where a split begins
    at = F.struct("row", "i", "key")
    ends = found.where((F.col("kind") == "open") & (F.col("depth") < 3)).groupBy(*_SPLIT).agg(
        *[F.max(F.when(F.col("depth") == d, at)).alias(f"c{d}") for d in range(3)])
    ends = side.select(*_SPLIT).join(ends, _SPLIT, "left").select(
        *_SPLIT, *[F.last(f"c{d}", ignorenulls=True).over(before)["key"].alias(f"c{d}") for d in range(3)])
    out = found.join(small_side(ends, 100_000), _SPLIT)
    in_force = [F.when(F.col("depth") > d, F.when(F.col(f"h{d}").isNotNull(), F.col(f"h{d}.key")).otherwise(F.col(f"c{d}"))) for d in range(3)]
    # an opened table heads what follows, not itself: at its own depth the column is its key no more
    return out.select(*_SPLIT, "row", "i", "kind", "key", "value", "depth", in_force[1].alias("section"), in_force[2].alias("spell"),
                      in_force[0].alias("root"), "line").where(F.coalesce(F.col("root") == F.lit(root), F.lit(False)) & (F.col("depth") > 0)).drop("root")


def read_event_dump(spark: SparkSession, path, root: str = DEFAULT_ROOT, errors: str = "raise",
                    unknown_sections: str = "ignore", numbers: str = "long") -> DataFrame:
    """Scan dump files into ``EVENT_DUMP_SCHEMA`` rows (order unspecified).

    ``errors``: ``"raise"`` fails on an entry outside the grammar or a number that is not whole
    (as the reference does), ``"drop"`` skips such entries, ``"column"`` keeps them with the raw
    line in an extra ``_error`` column. ``unknown_sections``: ``"ignore"`` or ``"raise"``.
    ``numbers="variant"`` admits any number as an amount, as a variant (``EVENT_DUMP_VARIANT_SCHEMA``).
    """
    if errors not in ("raise", "drop", "column"):
        raise ValueError("errors must be 'raise', 'drop' or 'column'")
    if unknown_sections not in ("ignore", "raise"):
        raise ValueError("unknown_sections must be 'ignore' or 'raise'")
    if numbers not in ("long", "variant"):
        raise ValueError("numbers must be 'long' or 'variant'")
    schema = EVENT_DUMP_SCHEMA if numbers == "long" else EVENT_DUMP_VARIANT_SCHEMA
    ctx = event_dump_entries(spark, path, root)
    sec, entry = F.col("section"), F.col("kind") == "entry"
    spell = _whole(F.col("spell"))
    known = sec.isNull() | sec.isin(ACTION_SECTION, DAMAGE_SECTION)
    is_amount = _whole(F.col("value")) if numbers == "long" else F.col("value").try_cast("double")
    none = F.coalesce(F.col("value") == "nil", F.lit(False))
    inside = entry & (F.col("depth") == 3) & spell.isNotNull()
    good_action = inside & (sec == ACTION_SECTION) & _whole(F.col("value")).isNotNull()
    good_damage = inside & (sec == DAMAGE_SECTION) & _whole(F.col("key")).isNotNull() & is_amount.isNotNull()
    bad = known & F.when(entry, ~(good_action | good_damage | none)).when(F.col("kind") == "open", F.col("depth") > 2).otherwise(True)
    if unknown_sections == "raise":
        strange = (F.col("kind") == "open") & (F.col("depth") == 1) & ~F.coalesce(F.col("key").isin(ACTION_SECTION, DAMAGE_SECTION), F.lit(False))
        bad = bad | strange

    # only well-formed rows are emitted, where these are never null: coalesce with a literal
    # types them as non-null, as the fixed schema says
    rows = ctx.select(
        "file", F.struct("block", "row", "i").alias("_at"), "line", F.coalesce(bad, F.lit(True)).alias("_bad"),
        F.when(good_action | (inside & none & (sec == ACTION_SECTION)), F.lit("a"))
        .when(good_damage | (inside & none & (sec == DAMAGE_SECTION)), F.lit("d")).alias("_kind"),
        F.coalesce(spell, F.lit(0).cast("bigint")).alias("_spell"), "key", "value",
        F.when(sec == ACTION_SECTION, _whole(F.col("value"))).otherwise(_whole(F.col("key"))).alias("_ms"))
    if errors == "raise":
        rows = rows.withColumn("_kind", F.when(
            F.col("_bad"), F.raise_error(F.concat(F.lit("event dump: cannot read a line of "),
                                                  F.col("file"), F.lit(": "), F.col("line")))
            .cast("string")).otherwise(F.col("_kind")))

    action_type, damage_type = schema["action"].dataType, schema["damage"].dataType
    action, damage = rows.where((F.col("_kind") == "a") & ~F.col("_bad")), rows.where((F.col("_kind") == "d") & ~F.col("_bad"))
    # one table key per (file, spell, key): the last one wins; an action without a key is its own
    keyed = (action.where("key is not null").groupBy("file", "_spell", "key").agg(F.max_by(F.struct("_ms"), "_at").alias("last"))
             .select("_spell", F.col("last._ms").alias("_ms")))
    actions = (action.where("key is null").select("_spell", "_ms").unionByName(keyed).where("_ms is not null")
               .select(F.timestamp_millis("_ms").alias("timestamp"), F.struct(F.col("_spell").alias("spellId")).alias("action"),
                       F.lit(None).cast(damage_type).alias("damage")))
    amount = F.coalesce(_whole(F.col("last.value")), F.lit(0).cast("bigint")) if numbers == "long" else _number(F.col("last.value"))
    damages = (damage.groupBy("file", "_spell", "_ms").agg(F.max_by(F.struct("value"), "_at").alias("last"))
               .where("last.value <> 'nil'")
               .select(F.timestamp_millis("_ms").alias("timestamp"), F.lit(None).cast(action_type).alias("action"),
                       F.struct(F.col("_spell").alias("spellId"), amount.alias("amount")).alias("damage")))
    out = actions.unionByName(damages)
    if errors == "column":
        errs = rows.where("_bad").select(
            F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast(action_type).alias("action"),
            F.lit(None).cast(damage_type).alias("damage"), F.col("line").alias("_error"))
        out = out.withColumn("_error", F.lit(None).cast("string")).unionByName(errs)
    return out
