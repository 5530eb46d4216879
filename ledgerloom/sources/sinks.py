"""Sinks: write policies, skipping what is there already, upserts of saved chats."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = {"overwrite": "overwrite", "skip": "ignore", "append": "append"}


def write(df: DataFrame, path: str, policy: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet under path by one of three policies; stores are partition columns, so that a query reads its own only."""
    writer = df.write.mode(POLICIES[policy])
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def not_there_yet(df: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(there.select(*keys).distinct(), keys, "left_anti")


def chat_file(name: str) -> str:
    return re.sub(r"#", "", name.replace(" ", "_")) + ".json"


def chats(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each chat: its messages in order, as [role, text], and JSON of them."""
    said = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return turns.groupBy(key).agg(F.to_json(F.transform(said, lambda m: F.array(m["role"], m["text"]))).alias("messages"))


def read_rules(text: str) -> dict:
    """A configuration of JSON or YAML text, read on the driver."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def prompt(template: str, variables: dict[str, str], guardrails: str = "") -> str:
    """{{name}} replaced by the variable's text; guardrails follow."""
    for name, value in variables.items():
        template = template.replace("{{" + name + "}}", value)
    return f"{template}\n\n{guardrails}".strip()
