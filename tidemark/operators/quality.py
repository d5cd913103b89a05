"""Data-quality rules: each a condition for bad rows, all counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import Contract


def report(df: DataFrame, rules: dict[str, Column], key: tuple[str, ...] = (), count_all: bool = True) -> DataFrame:
    """rule, violations.  ``count_all``: all members of groups of equal keys count, else only the repeats."""
    counts = df.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("empty"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    names = ["empty", *rules]
    out = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in names))).alias("r")).select("r.rule", "r.violations")
    if key:
        per = df.where(" and ".join(f"`{k}` is not null" for k in key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        dup = per.agg(F.coalesce(F.sum(F.col("n") if count_all else F.col("n") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(dup.select(F.lit("unique_key").alias("rule"), "violations"))
    return out


def contract_rules(contract: Contract) -> dict[str, Column]:
    rules = {f"null_{c}": F.col(c).isNull() for c in contract.required}
    rules |= {f"domain_{c}": ~F.col(c).isin(*values) for c, values in contract.domains.items()}
    rules |= {f"range_{c}": ~F.col(c).between(*ends) for c, ends in contract.ranges.items()}
    rules |= {f"width_{c}": F.length(c) > n for c, n in contract.widths.items()}
    rules |= {f"blank_{c}": F.trim(c) == "" for c in contract.filled}
    return rules


def iso_rules(df: DataFrame, contract: Contract) -> dict[str, Column]:
    """Times that ``df`` holds as text must be whole ISO times in UTC."""
    text = [c for c, t in df.dtypes if t == "string" and contract.columns.get(c) == "timestamp"]
    good = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|\+00:00)$") & F.try_to_timestamp(F.col(c)).isNotNull()
    return {f"iso_{c}": F.col(c).isNotNull() & ~good(c) for c in text}


def checked(df: DataFrame, contract: Contract, more: dict[str, Column] | None = None, count_all: bool = True, exact: bool = False) -> DataFrame:
    """The contract's report; missing (and, if ``exact``, extra) columns raise."""
    lack = [c for c in contract.columns if c not in df.columns]
    extra = [c for c in df.columns if c not in contract.columns] if exact else []
    if lack or extra:
        raise ValueError(f"missing columns {lack}, extra columns {extra}")
    return report(df, contract_rules(contract) | iso_rules(df, contract) | (more or {}), contract.key, count_all)


def enforce(found: DataFrame, warnings: tuple[str, ...] = ()) -> bool:
    """True, or ValueError that names the rules with violations; a row per rule comes to the driver."""
    bad = {r["rule"]: r["violations"] for r in found.where("violations > 0").collect() if r["rule"] not in warnings}
    if bad:
        raise ValueError(f"rules violated: {bad}")
    return True
