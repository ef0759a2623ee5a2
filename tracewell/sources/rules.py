"""Block-rule files: one rule per line, bad lines skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule kinds and the form of a uuid.
KINDS = ("user", "user_uuid", "command", "block", "entity")
UUID_PATTERN = r"^[0-9A-Fa-f]{1,8}(-[0-9A-Fa-f]{1,4}){3}-[0-9A-Fa-f]{1,12}$"


def parse_rules(lines: DataFrame) -> DataFrame:
    """``value`` lines to (kind, value) rows.

    ``kind:value``, or ``id@user`` where the id may hold a colon as long as
    what is before it is no known kind. Blank lines and ``#`` lines are
    comments. Values other than user names are compared in lower case anyway.
    """
    line = F.trim("value")
    at, colon = F.instr(line, "@"), F.instr(line, ":")
    head = F.lower(F.trim(F.substring_index(line, ":", 1)))
    known = head.isin(*KINDS)
    pair = (at > 1) & ((colon == 0) | (at < colon) | ~known)
    rest = F.trim(F.expr("substring(trim(value), instr(trim(value), ':') + 1)"))
    left = F.trim(F.substring_index(line, "@", 1))
    right = F.trim(F.expr("substring(trim(value), instr(trim(value), '@') + 1)"))
    rows = lines.filter((line != "") & ~line.startswith("#")).select(
        F.when(pair, "composite").when(colon > 0, head).alias("kind"),
        F.when(pair & (left != "") & (right != ""), F.concat(F.lower(left), F.lit("@"), right))
        .when(~pair & (rest != ""), F.when(head.isin("user", "user_uuid"), rest).otherwise(F.lower(rest)))
        .alias("value"),
    )
    good = F.col("kind").isin(*KINDS, "composite") & F.col("value").isNotNull()
    uuid = (F.col("kind") != "user_uuid") | F.col("value").rlike(UUID_PATTERN)
    return rows.filter(good & uuid).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(spark.read.text(path))
