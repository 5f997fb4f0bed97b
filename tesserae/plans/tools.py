"""Named, parameterized queries: typed arguments, unknown ones dropped, errors come back as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import REGISTRY, table


@dataclass
class Param:
    kind: type
    description: str
    default: object = None
    required: bool = False


@dataclass
class Tool:
    run: Callable[..., DataFrame]
    description: str
    params: dict[str, Param] = field(default_factory=dict)


def _run(name: str, spark: SparkSession, d: str) -> DataFrame:
    return REGISTRY[name].run(spark, d)


def top(n: int, what: str) -> dict[str, Param]:
    return {"n": Param(int, f"how many {what} (default {n})", n)}


def needed(name: str, what: str) -> dict[str, Param]:
    return {name: Param(str, what, required=True)}


def _holds(column: str, part: str):
    return F.lower(column).contains(part.lower())


TOOLS: dict[str, Tool] = {
    "topics_by_likelihood": Tool(lambda s, d, n: _run("topics_by_likelihood", s, d).orderBy(F.desc("best"), "topic").limit(n), "topics with the best scores", top(20, "topics")),
    "topics_by_under_preparation": Tool(lambda s, d, n: _run("topic_gap", s, d).where("share_gap_pp > 0").orderBy(F.desc("share_gap_pp"), "topic_ord").limit(n), "topics asked more than practised", top(20, "topics")),
    "problems_for_topic": Tool(lambda s, d, topic, n: _run("likelihood_rank", s, d).where(F.col("topic") == topic).orderBy(F.desc("score"), "doc_id").limit(n), "ranked problems of a topic", needed("topic", "the topic") | top(10, "problems")),
    "topic_summary": Tool(lambda s, d, topic: _run("topic_counts", s, d).where(F.col("topic") == topic), "counts of a topic", needed("topic", "the topic")),
    "recent_mistakes": Tool(lambda s, d, n: _run("enriched_mistakes", s, d).orderBy(F.desc("l_orderkey"), "l_linenumber").limit(n), "latest mistakes", top(20, "mistakes")),
    "mistake_explanation": Tool(lambda s, d, assignment, question: _run("enriched_mistakes", s, d).where(_holds("supplier", assignment) & _holds("part", question)).orderBy("l_orderkey", "l_linenumber").limit(1), "the first mistake that matches", needed("assignment", "part of the assignment's name") | needed("question", "part of the question's title")),
    "mistakes_by_assignment": Tool(lambda s, d, assignment: _run("enriched_mistakes", s, d).where(_holds("supplier", assignment)), "all mistakes of an assignment", needed("assignment", "part of the assignment's name")),
    "saved_problems": Tool(lambda s, d: _run("saved_left_join", s, d), "saved rows with their details"),
    "class_info": Tool(lambda s, d: table(s, d, "benchmark"), "stored text"),
    "formula_sheet": Tool(lambda s, d: table(s, d, "documents").where("source = 'src3'").select("doc_id", "text"), "stored text of a source"),
}
SCHEMA = "tool string, description string, param string, type string, required boolean, about string"


def schema_rows() -> list[tuple]:
    """A row for each parameter, and one with nulls for a tool that has none."""
    out = []
    for name, tool in TOOLS.items():
        rows = [(p, x.kind.__name__, x.required, x.description) for p, x in tool.params.items()] or [(None, None, None, None)]
        out += [(name, tool.description, *r) for r in rows]
    return out


def register(spark: SparkSession) -> None:
    """Makes the table function tool_schemas() known to the session."""
    rows = schema_rows()

    class ToolSchemas:
        def eval(self):
            yield from rows

    spark.udtf.register("tool_schemas", F.udtf(ToolSchemas, returnType=SCHEMA))


def call_tool(spark: SparkSession, d: str, name: str, args: dict | None) -> DataFrame:
    """The tool's rows; an unknown tool, a missing or unfit argument, or a failure gives one row with its error."""

    def error(text: str) -> DataFrame:
        return spark.createDataFrame([(text,)], "error string")

    tool = TOOLS.get(name)
    if tool is None:
        return error(f"unknown tool {name}")
    given = {k: v for k, v in (args or {}).items() if k in tool.params}
    missing = [p for p, x in tool.params.items() if x.required and given.get(p) is None]
    if missing:
        return error(f"bad arguments for {name}: missing {', '.join(missing)}")
    try:
        values = {p: x.kind(given[p]) if given.get(p) is not None else x.default for p, x in tool.params.items()}
    except (TypeError, ValueError) as e:
        return error(f"bad arguments for {name}: {e}")
    try:
        return tool.run(spark, d, **values)
    except Exception as e:  # the caller gets a row, as for every other error
        return error(f"{name} failed: {e}")
