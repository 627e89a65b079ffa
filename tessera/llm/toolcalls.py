"""Tool-call linking for chat data, in DataFrame functions alone.

Calls and results meet in a hash join on conversation and identifier. Calls are ordered topologically
over the calls they depend on, arguments are parsed as JSON values and checked against their tool's
schema, and each call with its result becomes one canonical JSON text: keys sorted at every level, no
white space, absent fields left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CALL = ["conv_id", "call_id", "position", "tool", "arguments", "depends_on"]
RESULT = ["conv_id", "call_id", "position", "content"]
SCHEMA = ["tool", "field", "kind", "required", "least", "most", "choices"]


def _members(value: Column) -> Column:
    """An object's members by name; null for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _values(arguments: Column, field: Column) -> Column:
    """The values at a path, null where its last name is missing from an object that is there."""
    step = lambda vs, name: F.when(name == "[]", F.flatten(F.transform(F.filter(vs, lambda v: _items(v).isNotNull()), _items))).otherwise(
        F.transform(F.filter(vs, lambda v: _members(v).isNotNull()), lambda v: F.try_element_at(_members(v), name))
    )
    return F.aggregate(F.split(F.regexp_replace(field, r"\[\]", ".[]"), r"\."), F.array(arguments), step)


def _check(value: Column, rule: Column, names: Column) -> Column:
    """The fault that a value has under a rule, or null; names are those that its tool's rules give its members."""
    kind, shape = rule["kind"], F.schema_of_variant(value)
    ok = (
        F.when(kind == "string", shape == "STRING")
        .when(kind == "integer", shape.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"))
        .when(kind == "number", shape.rlike(r"^(BIGINT|DECIMAL\(.*\)|DOUBLE|FLOAT)$"))
        .when(kind == "boolean", shape == "BOOLEAN")
        .when(kind == "array", shape.startswith("ARRAY"))
        .when(kind == "object", shape.startswith("OBJECT"))
        .otherwise(F.lit(False))
    )
    amount = (
        F.when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))
        .when(kind == "array", F.size(_items(value)).cast("double"))
        .when(kind == "string", F.length(F.try_variant_get(value, "$", "string")).cast("double"))
    )
    extra = F.array_except(F.array_sort(F.map_keys(_members(value))), names)
    return (
        F.when(value.isNull() & rule["required"], F.concat(F.lit("missing "), rule["field"]))
        .when(value.isNull(), F.lit(None).cast("string"))
        .when(~ok, F.concat(F.lit("not a "), rule["kind"], F.lit(": "), rule["field"]))
        .when((amount < rule["least"]) | (amount > rule["most"]), F.concat(F.lit("out of range: "), rule["field"]))
        .when(rule["choices"].isNotNull() & ~F.array_contains(rule["choices"], F.try_variant_get(value, "$", "string")), F.concat(F.lit("not a choice: "), rule["field"]))
        .when((kind == "object") & (F.size(names) > 0) & (F.size(extra) > 0), F.concat(F.lit("unknown "), F.array_join(F.transform(extra, lambda k: F.concat(rule["field"], F.lit("."), k)), ", ")))
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with given (their arguments parsed, null if they are no JSON) and faults, an empty list for a valid call.

    schemas has a row for each value of a tool: field is its path, with a dot before a member of an object
    and [] for each item of an array (`to.name`, `tags[]`); kind is string, integer, number, boolean, array
    or object; least and most bound a number, a string's length or an array's size; choices, unless null,
    lists the values allowed, as text. A required member may be missing where its object is. Members that
    no rule names are faults, but for objects without any rule for a member. Null arguments are an empty
    object; a text that is no JSON object, or names a member twice, is a fault. A JSON null is a value of
    no kind. The schemas' table is aggregated to one row a tool and hash-joined; a null choices column may
    be absent.
    """
    if "choices" not in schemas.columns:
        schemas = schemas.withColumn("choices", F.lit(None).cast("array<string>"))
    rules = schemas.select(*SCHEMA).groupBy("tool").agg(F.array_sort(F.collect_set(F.struct(*SCHEMA[1:]))).alias("rules"))
    x = calls.withColumn("given", F.try_parse_json(F.coalesce(F.col("arguments"), F.lit("{}")))).join(rules, "tool", "left")
    fields = F.transform("rules", lambda r: r["field"])

    def within(path: Column) -> Column:
        """Names of the members that rules give the object at a path."""
        head = F.concat(path, F.lit("."))
        return F.transform(F.filter(fields, lambda f: f.startswith(head) & ~F.substr(f, F.length(head) + 1).rlike(r"[.\[]")), lambda f: F.substr(f, F.length(head) + 1))

    found = F.flatten(F.transform("rules", lambda r: F.transform(_values(F.col("given"), r["field"]), lambda v: _check(v, r, within(r["field"])))))
    top = F.filter(fields, lambda f: ~f.rlike(r"[.\[]"))
    extra = F.transform(F.array_except(F.array_sort(F.map_keys(_members(F.col("given")))), top), lambda k: F.concat(F.lit("unknown "), k))
    faults = F.concat(F.filter(found, lambda f: f.isNotNull()), extra)
    none = F.when(F.col("rules").isNull(), F.array(F.lit("unknown tool"))).when(_members(F.col("given")).isNull(), F.array(F.lit("arguments are no object")))
    return x.withColumn("faults", none.otherwise(faults)).drop("rules")


def ordered(calls: DataFrame) -> DataFrame:
    """calls with order_after, order_depth and cyclic: sorting by (order_after, order_depth, position, call_id) is topological.

    A call whose dependencies all stand before it keeps its position as order_after, so a transcript in
    order needs one look and no rounds. A dependency that stands later lifts its dependents to its own
    place, by rounds of equi-joins as many as the longest such chain; order_depth then orders the lifted
    calls of one place. Dependencies that name no call, or the call itself, are void. Calls on a cycle, or
    after one, are marked and come after the others of their place.
    """
    ensure_checkpoint_dir(calls.sparkSession)
    base = calls.withColumns({"order_after": F.col("position").cast("long"), "order_depth": F.lit(0), "cyclic": F.lit(False)})
    edges = calls.select("conv_id", "call_id", F.col("position").cast("long").alias("p"), F.explode("depends_on").alias("on")).where(F.col("on") != F.col("call_id")).distinct()
    places = calls.groupBy("conv_id", "call_id").agg(F.max("position").cast("long").alias("place"))
    late = edges.join(places.select("conv_id", F.col("call_id").alias("on"), F.col("place").alias("on_place")), ["conv_id", "on"])
    late = late.where("on_place >= p").select("conv_id", "call_id").distinct().checkpoint()
    if late.isEmpty():
        return base
    edges = edges.select("conv_id", "call_id", "on").distinct().checkpoint()
    place = places
    while True:
        lifted = edges.join(place.select("conv_id", F.col("call_id").alias("on"), F.col("place").alias("up")), ["conv_id", "on"]).groupBy("conv_id", "call_id").agg(F.max("up").alias("up"))
        new = place.join(lifted, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("place", "up").alias("place"), (F.coalesce(F.col("up"), F.col("place")) > F.col("place")).alias("moved")).checkpoint()
        place = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    # Depth among the calls of one place: those that need none of it first, then each after what it needs.
    same = edges.join(place, ["conv_id", "call_id"]).join(place.select("conv_id", F.col("call_id").alias("on"), F.col("place").alias("up")), ["conv_id", "on"]).where("place = up").select("conv_id", "call_id", "on").checkpoint()
    needy = same.select("conv_id", "call_id").distinct().withColumn("needy", F.lit(True))
    depth = place.join(needy, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "place", F.when(F.col("needy").isNull(), 0).alias("depth")).checkpoint()
    while True:
        need = same.join(depth.select("conv_id", F.col("call_id").alias("on"), F.col("depth").alias("d")), ["conv_id", "on"])
        need = need.groupBy("conv_id", "call_id").agg(F.max("d").alias("d"), (F.count("d") == F.count("*")).alias("ready"))
        new = depth.join(need, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "place", F.coalesce("depth", F.when(F.col("ready"), F.col("d") + 1)).alias("depth"), (F.col("depth").isNull() & F.coalesce("ready", F.lit(False))).alias("moved")).checkpoint()
        depth = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    found = depth.select("conv_id", "call_id", F.col("place").alias("order_after"), F.coalesce("depth", F.lit(2**31 - 1)).alias("order_depth"), F.col("depth").isNull().alias("cyclic"))
    return calls.join(found, ["conv_id", "call_id"], "left").withColumns({"order_after": F.coalesce("order_after", F.col("position").cast("long")), "order_depth": F.coalesce("order_depth", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))})


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each call, and for each result without a call, with its order, status, faults and canonical JSON.

    calls: conv_id, call_id, position, tool, arguments (a JSON text), depends_on array<string>.
    results: conv_id, call_id, position, content. schemas: as for validated().

    status is ok, unanswered (a call without result), early (its first result stands before it) or orphan
    (a result without call). Of several results of one identifier the first by position and content holds
    and results counts them all. Repeated calls stay, each with the same result. A call or result with a
    null identifier links to nothing. Only the named columns are read, so others cannot clash; empty
    tables give an empty result. Texts of any length are parsed and written whole. Arguments that are no
    JSON stand in the canonical text as arguments_text, as they came.
    """
    calls, results = calls.select(*CALL), results.select(*RESULT)
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("r"), F.count("*").alias("results"))
    named = first.where("conv_id is not null and call_id is not null")
    x = validated(ordered(calls), schemas).join(named, ["conv_id", "call_id"], "left")
    status = F.when(F.col("r").isNull(), "unanswered").when(F.col("r.position") < F.col("position"), "early").otherwise("ok")
    x = x.select(
        "conv_id", "call_id", "position", "order_after", "order_depth", "cyclic", status.alias("status"), F.coalesce("results", F.lit(0)).alias("results"),
        (F.size("faults") == 0).alias("valid"), F.array_join("faults", "; ").alias("faults"), "tool", "arguments", "given", F.col("r.content").alias("content"),
    )
    ids = calls.select("conv_id", "call_id").distinct()
    orphan = first.join(ids, ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "call_id", F.col("r.position").alias("position"), F.col("r.position").cast("long").alias("order_after"), F.lit(0).alias("order_depth"), F.lit(False).alias("cyclic"),
        F.lit("orphan").alias("status"), "results", F.lit(False).alias("valid"), F.lit("no call").alias("faults"), F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("variant").alias("given"), F.col("r.content").alias("content"),
    )
    both = x.unionByName(orphan)
    # Fields in the order of their names, as parsing puts those of the arguments; to_json leaves null fields out.
    body = F.struct(F.when(F.col("arguments").isNotNull(), F.col("given")).alias("arguments"), F.when(F.col("given").isNull(), F.col("arguments")).alias("arguments_text"), "content", F.col("call_id").alias("id"), F.col("tool").alias("name"), "status", "valid")
    return both.withColumn("canonical", F.to_json(body, {"ignoreNullFields": "true"})).drop("arguments", "given", "content", "tool")


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain chat turns (conv_id, turn, role, text).

    A user's turn is a call of the tool `reply` with its text as prompt and its turn number; the
    assistant's turn that follows answers it, and each call depends on the one two turns before. A
    system's turn is a call of the tool `setup`, which nothing answers and which waits for the
    conversation's last user's turn: a dependency that stands later. An assistant's turn that follows
    no user's is a result without call.
    """
    x = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("position"), "role", F.col("text").cast("string").alias("text"))
    last = x.where("role = 'user'").groupBy("conv_id").agg(F.max("position").alias("last"))
    asked = x.where("role in ('user', 'system')").join(last, "conv_id", "left")
    calls = asked.select(
        "conv_id", F.col("position").cast("string").alias("call_id"), "position", F.when(F.col("role") == "user", "reply").otherwise("setup").alias("tool"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("position").alias("turn"))).alias("arguments"),
        F.array(F.when(F.col("role") == "user", F.col("position") - 2).otherwise(F.col("last")).cast("string")).alias("depends_on"),
    )
    results = x.where("role = 'assistant'").select("conv_id", (F.col("position") - 1).cast("string").alias("call_id"), "position", F.col("text").alias("content"))
    return calls, results


def chat_schemas(spark) -> DataFrame:
    """The schemas of turns_as_calls: a prompt of 1 to 400 characters and a turn number from 0; a setup prompt of any length."""
    rows = [("reply", "prompt", "string", True, 1.0, 400.0), ("reply", "turn", "integer", True, 0.0, None), ("setup", "prompt", "string", True, 1.0, None), ("setup", "turn", "integer", True, 0.0, 0.0)]
    return spark.sql("select * from values " + ", ".join(f"('{t}', '{f}', '{k}', {str(r).lower()}, {a if a is not None else 'null'}D, {f'{b}D' if b is not None else 'cast(null as double)'})" for t, f, k, r, a, b in rows) + " as s(tool, field, kind, required, least, most)").withColumn("choices", F.lit(None).cast("array<string>"))
