"""Program analysis over tables of source files: one kernel per file, rows out, nothing shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.analysis import braces
from graphloom.analysis import flow as fl
from graphloom.functions.paths import language_of

#: A batch of result rows.
_ROWS = 50_000


def _flows(language: str, text: str):
    """(name, definition, flow) of each function; one that is nested too deeply is left out."""
    if language != "python":
        yield from braces.flows(text, language)
        return
    for name, node in fl.functions(text):
        try:
            yield name, node, fl.build(node)
        except RecursionError:
            continue


def _per_function(files: DataFrame, schema: str, rows: Callable) -> DataFrame:
    """rows(function name, definition, flow) of every function of the files; broken files give none."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for file_id, language, text in zip(batch["file_id"], batch["language"], batch["source_text"], strict=True):
                for name, node, flow in _flows(language, text):
                    out += [(file_id, name, node.lineno, *r) for r in rows(name, node, flow)]
                if len(out) >= _ROWS:
                    yield pd.DataFrame(out, columns=["file_id", "function", "line", *columns])
                    out = []
        yield pd.DataFrame(out, columns=["file_id", "function", "line", *columns])

    known = files.withColumn("language", language_of(F.col("rel_path"))).filter(F.col("language").isin("python", *braces.LANGUAGES) & F.col("source_text").isNotNull())
    return known.dropDuplicates(["file_id"]).select("file_id", "language", "source_text").mapInPandas(run, f"file_id bigint, function string, line int, {schema}")


def control_flow(files: DataFrame) -> DataFrame:
    return _per_function(files, "src int, dst int, label string", lambda n, f, g: sorted(g.edges))


def unreachable_code(files: DataFrame) -> DataFrame:
    return _per_function(files, "first_line int, last_line int", lambda n, f, g: fl.unreachable(g))


def post_dominance(files: DataFrame) -> DataFrame:
    """Immediate post-dominator of each statement; null for none."""
    return _per_function(files, "node int, post_dominator double", lambda n, f, g: sorted((k, v) for k, v in fl.immediate_post_dominators(fl.post_dominators(g)).items() if k != fl.EXIT)).withColumn("post_dominator", F.when(~F.isnan("post_dominator"), F.col("post_dominator").cast("int")))


def dependence_edges(files: DataFrame) -> DataFrame:
    return _per_function(files, "src int, dst int, dep string, what string", lambda n, f, g: fl.dependence_graph(g))


def definition_uses(files: DataFrame) -> DataFrame:
    """Strong and weak definitions and uses of each statement, as sorted lists."""

    def rows(name, node, g):
        for k, (_, _, s) in g.statements.items():
            n = fl.names(s)
            yield k, ",".join(sorted(n.strong)), ",".join(sorted(n.weak)), ",".join(sorted(n.uses))

    return _per_function(files, "node int, strong string, weak string, uses string", rows)


def output_slices(files: DataFrame) -> DataFrame:
    """Lines of the backward slice from each function's last statement, and whether they include an observable output."""

    def rows(name, node, g):
        if g.statements:
            last = max(g.statements)
            lines = fl.slice_lines(g, g.statements[last][0])
            outputs = fl.output_nodes(g, node)
            yield ",".join(map(str, lines)), len(lines), any(g.statements[k][0] in lines for k in outputs)

    return _per_function(files, "slice string, n_lines int, shows boolean", rows)


def refine_suspects(suspects: DataFrame, files: DataFrame) -> DataFrame:
    """suspects (file_id, changed_line, ...) without those whose every changed line is unreachable code.

    Output-relevant lines are marked and lines without effect come last; nothing else is dropped.
    """
    dead = unreachable_code(files).select("file_id", F.explode(F.sequence("first_line", "last_line")).alias("changed_line")).distinct().withColumn("dead", F.lit(True))

    def relevant(name, node, g):
        lines = {x for k in fl.output_nodes(g, node) for x in fl.slice_lines(g, g.statements[k][0])}
        return [(x,) for x in sorted(lines)]

    shown = _per_function(files, "changed_line int", relevant).select("file_id", "changed_line").distinct().withColumn("shows", F.lit(True))
    marked = suspects.join(dead, ["file_id", "changed_line"], "left").join(shown, ["file_id", "changed_line"], "left").fillna(False, ["dead", "shows"])
    alive = marked.groupBy("suspect").agg(F.min("dead").alias("all_dead"))
    return marked.join(alive.filter("NOT all_dead"), "suspect", "left_semi")
