"""The tool functions as SQL table functions of a session: a caller names one and gets rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UDF-01, UDF-02: name, parameters, result, body over the registered views.
TOOLS = {
    "search_symbols": ("q STRING, k STRING DEFAULT NULL", "name STRING, kind STRING, file_path STRING, start_line INT", "SELECT name, kind, file_path, start_line FROM {symbols} WHERE contains(lower(name), lower(q)) AND (k IS NULL OR lower(kind) = lower(k)) ORDER BY name, file_path, start_line LIMIT 10"),
    "retrieve_class": ("q STRING", "name STRING, file_path STRING, start_line INT, end_line INT", "SELECT name, file_path, start_line, end_line FROM {symbols} WHERE lower(name) = lower(q) AND kind IN ('class','interface','struct','record','enum') ORDER BY file_path, start_line LIMIT 5"),
    "query_call_graph": ("q STRING", "direction STRING, neighbour STRING", "SELECT direction, neighbour FROM (SELECT DISTINCT 'caller' AS direction, caller_symbol AS neighbour FROM {edges} WHERE callee_symbol = q UNION ALL SELECT DISTINCT 'callee', callee_symbol FROM {edges} WHERE caller_symbol = q) ORDER BY direction, neighbour LIMIT 40"),
    "find_usages": ("q STRING", "caller STRING, callee STRING", "SELECT DISTINCT caller_symbol, callee_symbol FROM {edges} WHERE caller_symbol = q OR callee_symbol = q ORDER BY 1, 2 LIMIT 25"),
    "read_code_file": ("p STRING, first INT DEFAULT 1, last INT DEFAULT 500", "line INT, text STRING", "SELECT pos + 1, col FROM {files} LATERAL VIEW posexplode(split(content, '\\n')) AS pos, col WHERE file_path = p AND pos + 1 BETWEEN first AND last ORDER BY pos"),
}
#: UDF-03: stages at which tools may be called, and which.
STAGES = {"plan": ["search_symbols", "query_call_graph"], "write": list(TOOLS), "render": []}


def register(spark: SparkSession, symbols: DataFrame, edges: DataFrame, files: DataFrame, prefix: str = "weft") -> list[str]:
    """UDF-01: the views and the functions over them, for this session. Returns the functions' names."""
    views = {"symbols": symbols, "edges": edges, "files": files}
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    for name, (params, result, body) in TOOLS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({params}) RETURNS TABLE ({result}) RETURN {body.format(**{v: f'{prefix}_{v}' for v in views})}")
    return [f"{prefix}_{name}" for name in TOOLS]


def available(stage: str, prefix: str = "weft") -> list[str]:
    """UDF-03: tools of a stage; an unknown stage has none."""
    return [f"{prefix}_{n}" for n in STAGES.get(stage, [])]


def call(spark: SparkSession, function: str, *arguments: object, allowed: list[str] | None = None) -> DataFrame:
    """UDF-02, UDF-04: one call by name, with bound arguments; a tool that is not allowed is refused."""
    if allowed is not None and function not in allowed:
        raise ValueError(f"{function} is not available")
    if not function.replace("_", "").isalnum():
        raise ValueError(function)
    return spark.sql(f"SELECT * FROM {function}({', '.join('?' for _ in arguments)})", args=list(arguments))
