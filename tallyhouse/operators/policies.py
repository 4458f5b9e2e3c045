"""Which policy statements apply to roles, groups and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.jsontext import statements
from tallyhouse.functions.lists import list_concat, list_distinct, no_nulls_empty


def all_policies(own: DataFrame, managed: DataFrame) -> DataFrame:
    """``(arn, policyStatements)`` of customer and managed policies together."""
    columns = ["arn", "policyStatements"]
    return own.select(columns).unionByName(managed.select(columns))


def attached_statements(
    attachments: DataFrame, policies: DataFrame, principal: str = "principal"
) -> DataFrame:
    """Distinct ``(principal, statement)`` pairs through attached policy arns.

    ``attachments`` has the principal and ``policyArn``. Arns no policy has
    contribute nothing. One row per pair: nothing is gathered per principal, and
    a policy attached nearly everywhere is a skewed key of the streamed side only.
    """
    pairs = attachments.select(principal, "policyArn").distinct()
    return (
        pairs.join(policies.withColumnRenamed("arn", "policyArn"), "policyArn")
        .select(principal, F.explode("policyStatements").alias("statement"))
        .distinct()
    )


def inline_statements(inline: Column) -> Column:
    """Statements of a map of inline policies (name -> document), as one list.

    A single statement object counts as a list of one.
    """
    return F.flatten(F.transform(no_nulls_empty(F.map_values(inline)), statements))


def effective_statements(
    principals: DataFrame,
    policies: DataFrame,
    key: list[str],
    attached: str = "attachedManagedPolicies",
    inline: str = "inlinePolicies",
    output: str = "effectivePolicyStatements",
) -> DataFrame:
    """Principals plus their distinct attached and inline statements, sorted.

    As in the inventory's original rule, the list is NULL for a principal none of
    whose attached arns is known, even if it has inline policies. Only the key
    and the arn travel to the policy join; the list of a principal is as long as
    its own record makes it.
    """
    arns = F.array_compact(F.array_distinct(F.map_values(F.col(attached))))
    found = (
        principals.select(*key, F.explode(arns).alias("policyArn"))
        .join(policies.withColumnRenamed("arn", "policyArn"), "policyArn")
        .groupBy(*key)
        .agg(F.flatten(F.collect_list("policyStatements")).alias("_attached"))
    )
    joined = principals.join(found, key, "left")
    everything = list_concat(F.col("_attached"), inline_statements(F.col(inline)))
    effective = F.when(
        F.col("_attached").isNotNull(), F.array_sort(list_distinct(everything))
    )
    return joined.withColumn(output, effective).drop("_attached")


def member_statements(
    users: DataFrame,
    groups: DataFrame,
    key: list[str],
    group_list: str = "groupList",
    column: str = "effectivePolicyStatements",
    scope_by_account: bool = True,
) -> DataFrame:
    """Users plus the statements of the groups they are in.

    Groups are found by name and, unless ``scope_by_account`` is off, by account:
    the same group name in two accounts means two groups. The result is never
    NULL. What the groups of one name offer is made one set first, statement by
    statement, so a user meets each of its names once, not every group so called.
    """
    on = ["groupName", "accountId"] if scope_by_account else ["groupName"]
    names = F.array_compact(F.array_distinct(F.col(group_list)))
    keep = list(dict.fromkeys([*key, *(["accountId"] if scope_by_account else [])]))
    membership = users.select(*keep, F.explode(names).alias("groupName"))
    offered = (
        groups.select(
            F.col("resourceName").alias("groupName"),
            *(["accountId"] if scope_by_account else []),
            F.explode(column).alias("_statement"),
        )
        .groupBy(*on)
        .agg(F.collect_set("_statement").alias("_statements"))
    )
    inherited = (
        membership.join(offered, on)
        .groupBy(*key)
        .agg(F.flatten(F.collect_list("_statements")).alias("_inherited"))
    )
    combined = list_distinct(list_concat(F.col(column), F.col("_inherited")))
    return (
        users.join(inherited, key, "left")
        .withColumn(column, F.array_sort(combined))
        .drop("_inherited")
    )
