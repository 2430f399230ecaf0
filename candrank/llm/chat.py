"""Chat formatting: tool calls and results are linked by identifier, ordered, validated and written as canonical JSON.

DataFrame functions only. A message's text may hold <tool_call>{"id", "name", "arguments"}</tool_call> and
<tool_response>{"id", "content"}</tool_response> parts. Arguments may refer to another call's result by the
string "$ref:ID"; that call then comes first.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm import common

# A tagged part: up to the closing tag of its kind, outside JSON strings where the part is JSON. Possessive, so that long parts need no deep stack.
_INSIDE = r'(?:[^"<]++|"(?:[^"\\\x00-\x1F]++|\\.)*+"|<(?!/tool_{0}>))*+'
_KINDS = ("call", "response")
TAGS = "(?s)" + "|".join(f"<tool_{k}>{_INSIDE.replace('{0}', k)}</tool_{k}>|<tool_{k}>.*?</tool_{k}>" for k in _KINDS)
FIRST_TAGS = "(?s)" + "|".join(f"<tool_{k}>.*?</tool_{k}>" for k in _KINDS)  # ... up to the first closing tag of its kind
BODY = r"(?s)^<[^>]*>(.*)</[^>]*>$"
# Fixed value: argument, kind and whether it is needed, of each tool that is known where no schemas are given.
SCHEMAS = (("search", "query", "STRING", True), ("search", "limit", "BIGINT", False), ("fetch", "url", "STRING", True), ("calculate", "expression", "STRING", True))


def default_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCHEMAS), "name string, argument string, kind string, needed boolean")


def canonical(json: Column) -> Column:
    """JSON text without spaces and with ascending keys at every level; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def events(messages: DataFrame) -> DataFrame:
    """A row for what is left of each message without its tagged parts (unless that is blank and there are parts), and one for each part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"), F.regexp_extract_all(text, F.lit(TAGS), F.lit(0)).alias("found"))
    # an open string could take in what follows: where a part is no JSON, the message's tags end at the first closing ones
    sound = F.forall("found", lambda x: F.try_parse_json(F.regexp_extract(x, BODY, 1)).isNotNull())
    read = read.withColumn("sound", sound).withColumn("found", F.when(F.col("sound"), F.col("found")).otherwise(F.regexp_extract_all("text", F.lit(FIRST_TAGS), F.lit(0))))
    rest = F.trim(F.when(F.col("sound"), F.regexp_replace("text", TAGS, "")).otherwise(F.regexp_replace("text", FIRST_TAGS, "")))
    plain = read.where((F.size("found") == 0) | (rest != "")).select("conv_id", "turn", "role", F.lit(0).alias("part"), F.lit("message").alias("kind"), F.when(F.size("found") == 0, F.col("text")).otherwise(rest).alias("body"))
    tagged = read.select("conv_id", "turn", "role", F.posexplode("found").alias("part", "x")).select(
        "conv_id", "turn", "role", (F.col("part") + 1).alias("part"), F.when(F.col("x").startswith("<tool_call>"), "call").otherwise("result").alias("kind"), F.regexp_extract("x", BODY, 1).alias("body")
    )
    both = plain.unionByName(tagged)
    json = F.when(F.col("kind") != "message", F.try_parse_json("body"))
    return both.withColumn("json", json).select(
        "conv_id", "turn", "part", "role", "kind", "body",
        F.try_variant_get("json", "$.id", "string").alias("call_id"), F.try_variant_get("json", "$.name", "string").alias("name"),
        F.to_json(F.try_variant_get("json", "$.arguments", "variant")).alias("arguments"), F.to_json(F.try_variant_get("json", "$.content", "variant")).alias("content"),
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with valid: the tool is known, needed arguments are there, and each one is known and of its kind.

    Of several rows for an argument each gives a kind that it may have, and it is needed if one says so. Rows
    without a name are passed over, rows without an argument make their tool known.
    """
    kinds = schemas.where(F.col("name").isNotNull()).groupBy("name", "argument").agg(F.collect_set("kind").alias("kinds"), F.coalesce(F.max("needed"), F.lit(False)).alias("needed"))
    entry = F.when(F.col("argument").isNotNull(), F.struct("argument", F.struct("kinds", "needed")))
    tools = kinds.groupBy("name").agg(F.map_from_entries(F.collect_list(entry)).alias("known"))  # as many entries as the tool has arguments
    given = F.map_entries(F.try_parse_json("arguments").cast("map<string,variant>"))
    given = F.when(F.substring("arguments", 1, 1) == "{", F.transform(given, lambda e: F.struct(e["key"].alias("argument"), F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0).alias("kind"))))
    out = calls.withColumn("given", given).join(tools, "name", "left")
    needed = F.map_keys(F.map_filter("known", lambda k, v: v["needed"]))
    fits = F.forall("given", lambda g: F.coalesce(F.array_contains(F.try_element_at("known", g["argument"])["kinds"], g["kind"]), F.lit(False)))
    there = F.size(F.array_except(needed, F.transform("given", lambda g: g["argument"]))) == 0
    return out.withColumn("valid", F.coalesce(there & fits, F.lit(False))).drop("given", "known")


def peeled(refs: DataFrame, first: DataFrame, known: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """conv_id, call_id, at, depth of the calls of refs that follow from the known ones: a round places those whose needs all are.

    A reference to a call that waits for one other is led on to that one, so chains take as many rounds as
    their length has binary digits. The rounds end when one places nothing: what is left waits for a cycle.
    """
    call = ["conv_id", "call_id"]
    kept = "conv_id string, call_id string, at long, depth long"
    # of the known calls those that a reference names, to which the calls placed are added
    scratch.keep(known.join(refs.select("conv_id", F.col("needs").alias("call_id")), call, "left_semi").select(*call, "at", "depth"), f"{name}-known")
    to = lambda df: df.select("conv_id", F.col("call_id").alias("needs"), F.lit(None).cast("string").alias("then"), F.col("depth").alias("more"), F.col("at").alias("at0"))
    hop = to(scratch.spark.read.schema(kept).parquet(scratch.path(f"{name}-known")))
    waiting = refs.join(first.select(*call, "at"), call).select(*call, "needs", F.lit(1).cast("long").alias("size"), "at")
    scratch.keep(known.select(*call, "at", "depth").limit(0), name)
    for turn in itertools.count():
        led = waiting.join(hop.withColumn("found", F.lit(True)), ["conv_id", "needs"], "left")
        # the sizes of what goes round in a cycle double and are never read
        led = led.select(*call, F.when(F.col("found"), F.col("then")).otherwise(F.col("needs")).alias("needs"), F.least(F.col("size") + F.coalesce("more", F.lit(0)), F.lit(1 << 40)).alias("size"), F.greatest("at", "at0").alias("at"))
        read = scratch.keep(led, f"{name}-{turn}")
        own = read.groupBy(*call).agg(F.count("*").alias("n"), F.count("needs").alias("open"), F.max("needs").alias("then"), F.max("size").alias("more"), F.max("at").alias("at0"))
        ready = own.where("open = 0")
        if turn:
            scratch.drop(f"{name}-{turn - 1}")
        if ready.isEmpty():
            break
        ready.select(*call, F.col("at0").alias("at"), F.col("more").alias("depth")).write.mode("append").parquet(scratch.path(name))
        waiting = read.join(ready.select(*call), call, "left_anti")
        so_far = scratch.spark.read.schema(kept).parquet(scratch.path(f"{name}-known"), scratch.path(name))
        hop = to(so_far).unionByName(own.where("n = 1 AND open = 1").select("conv_id", F.col("call_id").alias("needs"), "then", "more", "at0"))
    return scratch.spark.read.schema(kept).parquet(scratch.path(name))


def core(refs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """conv_id, call_id of the calls on a cycle or between two, from refs among calls that wait for a cycle: calls that none needs go, until all are needed."""
    n = refs.count()
    for turn in itertools.count():
        refs = scratch.keep(refs.join(refs.select("conv_id", F.col("needs").alias("call_id")), ["conv_id", "call_id"], "left_semi"), f"core-{turn}")
        before, n = n, refs.count()
        if n == before:
            return refs.select("conv_id", "call_id").distinct()


def placed(calls: DataFrame, scratch: common.Scratch) -> DataFrame:
    """conv_id, call_id, at, depth, cyclic of each call: after all the calls that its arguments refer to.

    at is the largest turn among the call's and those, and depth the longest chain of references, of any
    length. Calls on a cycle, or between two, are cyclic and come after what they need outside of these; calls
    that need them come after them and are not cyclic. Calls without references cost no further round.
    """
    call = ["conv_id", "call_id"]
    first = calls.groupBy(*call).agg(F.min("turn").cast("long").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cyclic"))
    first = scratch.keep(first, "calls")
    refs = calls.select(*call, F.explode(F.regexp_extract_all("arguments", F.lit(r'"\$ref:([^"]+)"'), F.lit(1))).alias("needs")).distinct()
    refs = scratch.keep(refs.join(first.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi"), "refs")
    out = lambda df: df.withColumn("depth", F.col("depth").cast("int"))
    if refs.isEmpty():
        return out(first)
    done = first.join(refs, call, "left_anti").unionByName(peeled(refs, first, first.join(refs, call, "left_anti"), scratch, "peeled").withColumn("cyclic", F.lit(False)))
    done = scratch.keep(done, "done")
    left = scratch.keep(refs.join(done, call, "left_anti"), "left")
    if left.isEmpty():
        return out(done)
    needed = lambda df: df.select("conv_id", F.col("call_id").alias("needs"), F.col("at").alias("at0"), (F.col("depth") + 1).alias("depth0"))
    rings = scratch.keep(core(left.join(done.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti"), scratch), "rings")
    before = left.join(rings, call, "left_semi").join(needed(done), ["conv_id", "needs"]).groupBy(*call).agg(F.max("at0").alias("at0"), F.max("depth0").alias("depth0"))
    rings = first.join(rings, call, "left_semi").join(before, call, "left").select(*call, F.greatest("at", "at0").alias("at"), F.coalesce("depth0", "depth").alias("depth"), F.lit(True).alias("cyclic"))
    done = scratch.keep(done.unionByName(rings), "with-rings")
    rest = peeled(left.join(done, call, "left_anti"), first, done, scratch, "after-rings").withColumn("cyclic", F.lit(False))
    return out(done.unionByName(rest))


def link_tools(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row for each message or tagged part of messages(conv_id, turn, role, text, ...), with its place in the conversation and its JSON.

    conv_id, turn, part, kind (message, call, result), call_id, linked (a call with a result, a result with a
    call), valid (calls only), cyclic, at, depth, step, json. Sorting a conversation by at, depth, step, turn
    and part puts calls before their results and before the calls that need these; results without a call stay
    at their turn. Several calls of one id count as the first. Null text and role are empty. A part ends at the
    closing tag of its kind outside JSON strings, or, where one of the message's parts is no JSON, at the first
    one; tags of other kinds close nothing. Parts that are no JSON have no id; identifiers and names may hold any
    characters, numbers stand as their texts. schemas(name, argument, kind, needed) may have repeated rows and nulls, see validated; null conversations are linked among themselves. Repeated rows keep a row each; further
    columns are left out; an empty table gives no rows.
    """
    spark = messages.sparkSession
    scratch = common.Scratch(spark, "chat")
    every = scratch.keep(events(messages).withColumn("conv", F.to_json(F.struct("conv_id"))), "events")
    named = every.where(F.col("call_id").isNotNull())
    keys = named.groupBy("conv", "call_id").agg(F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "result").alias("results"))
    calls = named.where(F.col("kind") == "call").select(F.col("conv").alias("conv_id"), "call_id", "turn", "arguments")
    where = placed(calls, scratch).withColumnRenamed("conv_id", "conv")
    links = keys.join(where, ["conv", "call_id"], "left").hint("shuffle_hash")
    parts = every.where(F.col("kind") != "message")
    parts = validated(parts, schemas if schemas is not None else default_schemas(spark)).join(links, ["conv", "call_id"], "left")
    call = F.col("kind") == "call"
    # the parts' JSON is put together from canonical pieces, keys in ascending order
    as_json = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    tail = F.concat(F.lit(',"id":'), as_json(F.col("call_id")))
    text = F.to_json(F.struct(F.col("body").alias("content"), "role"))
    json = F.when(F.col("arguments").isNull() & F.col("content").isNull(), text).when(
        call, F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), tail, F.lit(',"name":'), as_json(F.col("name")), F.lit(',"role":"tool_call"}'))
    ).otherwise(F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), tail, F.lit(',"role":"tool_result"}')))
    parts = parts.select(
        "conv_id", "turn", "part", "kind", "call_id", F.coalesce(F.when(call, F.col("results") > 0).otherwise(F.col("calls") > 0), F.lit(False)).alias("linked"), F.when(call, F.col("valid")).alias("valid"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.when(call, F.coalesce("at", "turn")).otherwise(F.greatest("turn", "at")).alias("at"), (F.coalesce("depth", F.lit(0))).alias("depth"), F.when(call, 1).otherwise(2).alias("step"), json.alias("json"),
    )
    plain = every.where(F.col("kind") == "message").select(
        "conv_id", "turn", "part", "kind", "call_id", F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid"), F.lit(False).alias("cyclic"), F.col("turn").alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("step"), text.alias("json")
    )
    return plain.unionByName(parts)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tools(common.table(spark, sf_dir, "conversations"))
