"""Navigation maps: validation by constraint queries, where a URL leads, shortest paths, drafts from routes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import fragment_pairs, state_id, url_params, url_regex
from graphloom.functions.signatures import canonical_digest
from graphloom.runtime import cut

STATES = "map_id string, id string, url string, landmarks array<struct<role:string,name:string,checked:boolean>>, affordances array<struct<ref:string,role:string,name:string,css:string>>, fragment map<string,string>, draft boolean"
TRANSITIONS = "map_id string, seq int, src string, do string, dst string"


def violations(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """map_id, rule, what: every broken rule of the maps.

    Ids are unique; a state that is no draft has a landmark; refs are unique in their state and each affordance has a
    locator; transitions join known states, click or fill exactly one known affordance, and no two do the same.
    """
    ids = states.groupBy("map_id", "id").agg(F.count("*").alias("n"))
    a = states.select("map_id", "id", F.explode("affordances").alias("a")).select("map_id", "id", "a.*")
    known = states.select("map_id", F.col("id").alias("s")).distinct()
    act = transitions.select("map_id", "seq", "src", "dst", F.get_json_object("do", "$.click").alias("click"), F.get_json_object("do", "$.fill.ref").alias("fill"), "do")
    ref = F.coalesce("click", "fill")
    label = F.concat_ws("#", "src", "seq")
    rules = [
        ids.filter("n > 1").select("map_id", F.lit("repeated id").alias("rule"), F.col("id").alias("what")),
        states.filter(~F.coalesce("draft", F.lit(False)) & (F.coalesce(F.size("landmarks"), F.lit(0)) < 1)).select("map_id", F.lit("no landmark"), "id"),
        a.groupBy("map_id", "id", "ref").count().filter("count > 1").select("map_id", F.lit("repeated ref"), F.concat_ws(".", "id", "ref")),
        a.filter("css IS NULL AND (role IS NULL OR name IS NULL)").select("map_id", F.lit("no locator"), F.concat_ws(".", "id", "ref")),
        act.join(known.withColumnRenamed("s", "src"), ["map_id", "src"], "left_anti").select("map_id", F.lit("unknown state"), "src"),
        act.join(known.withColumnRenamed("s", "dst"), ["map_id", "dst"], "left_anti").select("map_id", F.lit("unknown state"), "dst"),
        act.filter(F.col("click").isNull() == F.col("fill").isNull()).select("map_id", F.lit("not one action"), label),
        act.filter(ref.isNotNull()).withColumn("ref", ref).join(a.select("map_id", F.col("id").alias("src"), "ref").distinct(), ["map_id", "src", "ref"], "left_anti").select("map_id", F.lit("unknown ref"), label),
        act.groupBy("map_id", "src", "do").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).filter("n > 1").select("map_id", F.lit("repeated action"), label),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out


def where(visits: DataFrame, states: DataFrame) -> DataFrame:
    """visit_id, state of each live URL (map_id, url): the most specific pattern, by parameters, fragments, then id.

    Candidates meet by map and number of path segments, then by pattern; all declared fragment pairs must be live.
    """
    segments = lambda c: F.size(F.split(c, "/"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", ""), "^$", "/")
    v = visits.withColumn("path", path).withColumn("live", fragment_pairs(F.col("url"))).withColumn("n", segments(F.col("path"))).select("visit_id", "map_id", "path", "live", "n")
    p = F.substring_index("url", "#", 1)
    s = states.select("map_id", "id", p.alias("pattern"), F.coalesce("fragment", F.create_map().cast("map<string,string>")).alias("want")).withColumn("n", segments(F.col("pattern"))).withColumn("regex", url_regex(F.col("pattern"))).withColumn("params", url_params(F.col("pattern")))
    met = v.join(s, ["map_id", "n"]).filter(F.expr("path RLIKE regex") & F.forall(F.map_entries("want"), lambda e: F.col("live")[e.key] == e.value))
    best = met.groupBy("visit_id").agg(F.min(F.struct("params", (-F.size("want")).alias("less"), "id")).alias("m"))
    return visits.select("visit_id").join(best.select("visit_id", F.col("m.id").alias("state")), "visit_id", "left").select("visit_id", F.coalesce("state", F.lit("LOST")).alias("state"))


def find_paths(transitions: DataFrame, starts: DataFrame, max_hops: int = 10) -> DataFrame:
    """map_id, start, state, path (transition numbers): the shortest way to every state, the first declared of equals.

    A breadth-first search visits states in the order of their paths, so among paths of one length the least array wins.
    """
    seen = frontier = starts.select("map_id", F.col("state").alias("start"), "state", F.array().cast("array<int>").alias("path"))
    for _ in range(max_hops):
        grown = frontier.join(transitions.select("map_id", F.col("src").alias("state"), "seq", "dst"), ["map_id", "state"])
        best = grown.groupBy("map_id", "start", F.col("dst").alias("state")).agg(F.min(F.concat("path", F.array("seq"))).alias("path"))
        frontier = cut(best.join(seen.select("map_id", "start", "state"), ["map_id", "start", "state"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter(F.size("path") > 0)


def draft_map(routes: DataFrame) -> DataFrame:
    """map_id, id, url of a draft state for each route pattern; equal ids get the suffixes ~2, ~3 ..."""
    base = routes.select("map_id", "pattern").distinct().withColumn("base", state_id(F.col("pattern")))
    k = F.row_number().over(Window.partitionBy("map_id", "base").orderBy("pattern"))
    return base.withColumn("k", k).select("map_id", F.when(F.col("k") > 1, F.concat_ws("~", "base", "k")).otherwise(F.col("base")).alias("id"), F.col("pattern").alias("url"))


def removed_routes(old: DataFrame, new: DataFrame, states: DataFrame) -> DataFrame:
    """States whose URL is a route that the change removes."""
    gone = old.select("map_id", "pattern").subtract(new.select("map_id", "pattern"))
    return states.join(gone.withColumnRenamed("pattern", "url"), ["map_id", "url"], "left_semi").select("map_id", "id", "url")


def read_maps(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, transitions and unreadable maps of JSON texts (map_id, json): a text that is no JSON object is unreadable."""
    state = "array<struct<id:string,url:string,landmarks:array<struct<role:string,name:string,checked:boolean>>,affordances:array<struct<ref:string,role:string,name:string,css:string>>,fragment:map<string,string>,draft:boolean>>"
    schema = f"version int, states {state}, transitions array<struct<from:string,do:string,to:string>>, _broken string"
    parsed = texts.withColumn("m", F.from_json("json", schema, {"columnNameOfCorruptRecord": "_broken"}))
    bad = parsed.filter("m IS NULL OR m._broken IS NOT NULL").select("map_id")
    good = parsed.filter("m IS NOT NULL AND m._broken IS NULL")
    states = good.select("map_id", F.explode("m.states").alias("s")).select("map_id", "s.*")
    moves = good.select("map_id", F.posexplode("m.transitions").alias("seq", "t")).select("map_id", "seq", F.col("t.from").alias("src"), F.col("t.do").alias("do"), F.col("t.to").alias("dst"))
    return states, moves, bad


def goto_plans(asked: DataFrame, transitions: DataFrame, states: DataFrame, max_hops: int = 10) -> DataFrame:
    """map_id, start, state, how (there, path, direct, unreachable) and path of each wish to get from one state to another.

    A declared path comes first. Without one, or from a state that is not known, a state is entered by its URL if that has
    no parameters; else it cannot be reached.
    """
    known = states.select("map_id", F.col("id").alias("state"))
    starts = asked.select("map_id", F.col("start").alias("state")).distinct().join(known, ["map_id", "state"], "left_semi")
    paths = find_paths(transitions, starts, max_hops)
    params = states.select("map_id", F.col("id").alias("state"), url_params(F.col("url")).alias("n_params"))
    met = asked.join(paths, ["map_id", "start", "state"], "left").join(params, ["map_id", "state"], "left")
    how = F.when(F.col("start") == F.col("state"), "there").when(F.col("path").isNotNull(), "path").when(F.col("n_params") == 0, "direct").otherwise("unreachable")
    return met.select("map_id", "start", "state", how.alias("how"), "path")


#: The keys of a map and its version.
MAP_KEYS, MAP_VERSION = ("version", "hash", "states", "transitions", "flows", "draft"), 1


def map_problems(texts: DataFrame) -> DataFrame:
    """map_id, problem of each map text (map_id, text) that is no JSON object, of another version, has unknown keys, or whose
    hash is not that of its content without the hash."""

    @F.pandas_udf("array<string>")
    def check(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            try:
                m = json.loads(t)
            except (TypeError, ValueError):
                m = None
            if not isinstance(m, dict):
                out.append(["no object"])
                continue
            found = [] if m.get("version") == MAP_VERSION else ["version"]
            found += [f"unknown key {k}" for k in sorted(set(m) - set(MAP_KEYS))]
            if "hash" in m and m["hash"] != canonical_digest({k: v for k, v in m.items() if k != "hash"}):
                found.append("hash")
            out.append(found)
        return pd.Series(out, dtype=object)

    return texts.select("map_id", F.explode(check("text")).alias("problem"))


def known_transitions(transitions: DataFrame, states: DataFrame) -> DataFrame:
    """Transitions between two known states of their map."""
    known = states.select("map_id", F.col("id").alias("state")).distinct()
    for end in ("src", "dst"):
        transitions = transitions.join(known.withColumnRenamed("state", end), ["map_id", end], "left_semi")
    return transitions
