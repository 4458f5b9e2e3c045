"""Built-in transforms of well-known resource types.

Each tidies what inference delivers: unpacks one-field objects, decodes policy
documents, turns lists of pairs into maps and gives loosely typed content a
schema. A field that no record of the type had counts as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.columns import (
    actual_name,
    field_or_null,
    field_type,
    quoted,
    replace_column,
    spread_names,
)
from tallyhouse.functions.jsontext import (
    decoded_document,
    is_array,
    is_object,
    json_elements,
    statements,
    typed,
    url_decode,
)
from tallyhouse.functions.lists import (
    blank_to_null,
    bound,
    list_concat,
    list_first,
    list_flatten,
    map_of,
    with_blanks_nulled,
)
from tallyhouse.operators.containment import contained_values
from tallyhouse.operators.policies import (
    all_policies,
    effective_statements,
    member_statements,
)
from tallyhouse.plans.transforms import GlobalTransform, Registry, Tables, Transform, has_column
from tallyhouse.schemas import KEY

_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)
_TEXT_VALUES = T.MapType(_TEXT, _TEXT)

# ----------------------------------------------------------------------------
# The fields of typed content, with their types.
# ----------------------------------------------------------------------------

APPLICATION = (
    "struct<ApplicationType:string,InstalledTime:string,Architecture:string,"
    "Version:string,Summary:string,PackageId:string,Publisher:string,"
    "Release:string,URL:string,Name:string,Epoch:string>"
)
WINDOWS_UPDATE = (
    "struct<installedtime:string,description:string,hotfixid:string,installedby:string>"
)
PATCH = (
    "struct<Id:string,Title:string,Status:string,InstalledTime:string,Severity:string,"
    "PatchSeverity:string,Classification:string,PatchState:string,"
    "PatchBaselineId:string,PatchGroup:string,CVEIds:string>"
)
COMPLIANCE_SUMMARY = (
    "struct<PatchBaselineId:string,PatchGroup:string,Status:string,OverallSeverity:string,"
    "NonCompliantCriticalCount:int,NonCompliantHighCount:int,"
    "NonCompliantMediumCount:int,NonCompliantLowCount:int,"
    "NonCompliantInformationalCount:int,NonCompliantUnspecifiedCount:int,"
    "CompliantCriticalCount:int,CompliantHighCount:int,CompliantMediumCount:int,"
    "CompliantLowCount:int,CompliantInformationalCount:int,CompliantUnspecifiedCount:int,"
    "ExecutionType:string,ComplianceType:string>"
)
DELIVERY_POLICY = (
    "struct<http:struct<defaultHealthyRetryPolicy:struct<minDelayTarget:int,"
    "maxDelayTarget:int,numRetries:int,numMaxDelayRetries:int,numNoDelayRetries:int,"
    "numMinDelayRetries:int,backoffFunction:string>,"
    "disableSubscriptionOverrides:boolean,"
    "defaultRequestPolicy:struct<headerContentType:string>>>"
)
POLICY_VERSIONS = "array<struct<isDefaultVersion:boolean,document:string>>"
ATTACHED = "array<struct<policyName:string,policyArn:string>>"
INLINE = "array<struct<policyName:string,policyDocument:string>>"

#: Compliance resource ids start with a prefix of this many characters.
COMPLIANCE_ID_PREFIX = 35
SUMMARY_KEY = "ComplianceSummary"


def _ddl(text: str) -> T.DataType:
    return T.DataType.fromDDL(text)


def _timestamp(text: Column) -> Column:
    return F.try_to_timestamp(blank_to_null(text))


# ----------------------------------------------------------------------------
# Instances, buckets, endpoints, topics
# ----------------------------------------------------------------------------


def instance_state(df: DataFrame) -> DataFrame:
    """State name and reason message instead of their objects."""
    df = replace_column(df, "state", field_or_null(df, ["state", "name"], _TEXT))
    return replace_column(
        df, "stateReason", field_or_null(df, ["stateReason", "message"], _TEXT)
    )


def bucket(df: DataFrame) -> DataFrame:
    """Owner id, ABAC status, access list as JSON text and policy document."""
    for column, path in {
        "owner": ["owner", "id"],
        "AbacStatus": ["AbacStatus", "status"],
        "AccessControlList": ["AccessControlList"],
        "BucketPolicy": ["BucketPolicy", "policytext"],
    }.items():
        df = replace_column(df, column, field_or_null(df, path, _TEXT))
    return df


def row_identity() -> Column:
    """One value per derived row. The key alone may repeat across regions, and a
    struct compares equal also where parts of it are NULL."""
    return F.struct(*KEY, "awsRegion", "arn")


def endpoint_addresses(endpoints: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Private addresses of the interfaces an endpoint lists."""
    numbered = endpoints.withColumn("_row", row_identity())
    out = contained_values(
        numbered,
        "_row",
        field_or_null(endpoints, ["networkInterfaceIds"], _TEXTS),
        interfaces.select(
            "resourceId",
            field_or_null(interfaces, ["privateIpAddress"], _TEXT).alias("_ip"),
        ),
        "resourceId",
        "_ip",
        "privateIpAddresses",
    )
    return out.drop("_row")


def topic(df: DataFrame) -> DataFrame:
    """Typed delivery policy and JSON policy, without the repeated columns."""
    df = replace_column(df, "Policy", field_or_null(df, ["Policy"], _TEXT))
    df = replace_column(
        df,
        "EffectiveDeliveryPolicy",
        field_or_null(df, ["EffectiveDeliveryPolicy"], _ddl(DELIVERY_POLICY)),
    )
    for name in ("TopicArn", "Tags_1"):
        held = actual_name(df, name)
        if held is not None:
            df = df.drop(held)
    return df


def organization_policy(df: DataFrame) -> DataFrame:
    """Policy content as JSON text."""
    return replace_column(df, "Content", field_or_null(df, ["Content"], _TEXT))


# ----------------------------------------------------------------------------
# Policies of roles, groups and users
# ----------------------------------------------------------------------------


def default_document(versions: Column) -> Column:
    """Decoded document of the default version of a policy."""
    chosen = list_first(F.filter(versions, lambda v: v["isDefaultVersion"]))
    return decoded_document(chosen["document"])


def policy_statements(policies: DataFrame) -> DataFrame:
    """Customer policies plus their default document and its statements."""
    versions = field_or_null(policies, ["policyVersionList"], _ddl(POLICY_VERSIONS))
    return policies.withColumn("policyDocument", default_document(versions)).withColumn(
        "policyStatements", statements(F.col("policyDocument"))
    )


def with_policy_maps(principals: DataFrame, inline_list: str) -> DataFrame:
    """Attached policies as name -> arn and inline policies as name -> document."""
    attached = field_or_null(principals, ["attachedManagedPolicies"], _ddl(ATTACHED))
    inline = field_or_null(principals, [inline_list], _ddl(INLINE))
    df = replace_column(
        principals,
        "attachedManagedPolicies",
        map_of(attached, "policyName", lambda x: x["policyArn"]),
    )
    return df.withColumn(
        "inlinePolicies",
        map_of(inline, "policyName", lambda x: decoded_document(x["policyDocument"])),
    )


def principal_policies(
    tables: Tables, scope_by_account: bool = True
) -> dict[str, DataFrame]:
    """Effective statements of roles, groups and users; users add their groups'."""
    own = policy_statements(tables["iam_policy"])
    policies = all_policies(own, tables["aws_managed_policy"])
    role = replace_column(
        tables["iam_role"],
        "assumeRolePolicyDocument",
        url_decode(field_or_null(tables["iam_role"], ["assumeRolePolicyDocument"], _TEXT)),
    )
    out = {"iam_policy": own}
    for table, df, inline in (
        ("iam_role", role, "rolePolicyList"),
        ("iam_group", tables["iam_group"], "groupPolicyList"),
        ("iam_user", tables["iam_user"], "userPolicyList"),
    ):
        numbered = with_policy_maps(df, inline).withColumn("_row", row_identity())
        out[table] = effective_statements(numbered, policies, ["_row"])
    users = replace_column(
        out["iam_user"],
        "groupList",
        field_or_null(out["iam_user"], ["groupList"], _TEXTS),
    )
    out["iam_user"] = member_statements(
        users, out["iam_group"], ["_row"], scope_by_account=scope_by_account
    )
    return {name: df.drop("_row") for name, df in out.items()}


# ----------------------------------------------------------------------------
# Managed instance inventory
# ----------------------------------------------------------------------------


def _content(df: DataFrame, column: str) -> Column:
    return field_or_null(df, [column, "Content"], _TEXT_VALUES)


def applications(content: Column) -> Column:
    """Typed applications of a map whose values are objects or arrays of objects."""

    def found(values: Column) -> Column:
        single = F.filter(values, is_object)
        several = F.transform(F.filter(values, is_array), json_elements)
        parsed = F.transform(
            list_concat(single, list_flatten(several)),
            lambda v: F.from_json(v, APPLICATION),
        )
        return F.transform(
            parsed, lambda a: a.withField("InstalledTime", _timestamp(a["InstalledTime"]))
        )

    return bound(F.map_values(content), found)


def windows_updates(content: Column) -> Column:
    """Typed updates by id, blanks as NULL, without NULL entries."""
    blanks = ["description", "hotfixid", "installedby"]
    present = F.map_filter(content, lambda _, v: v.isNotNull() & (v != "null"))
    # Parsed first and rewritten after, so that each entry is parsed once.
    parsed = F.transform_values(present, lambda _, v: F.from_json(v, WINDOWS_UPDATE))
    return F.transform_values(
        parsed,
        lambda _, u: with_blanks_nulled(u, blanks).withField(
            "installedtime", _timestamp(u["installedtime"])
        ),
    )


def instance_inventory(df: DataFrame) -> DataFrame:
    """Applications, updates and the instance's own fields as columns."""
    df = df.withColumn("applications", applications(_content(df, "AWS:Application")))
    df = df.withColumn(
        "windowsUpdates", windows_updates(_content(df, "AWS:WindowsUpdate"))
    )
    return flatten_instance(df)


def flatten_instance(df: DataFrame) -> DataFrame:
    """Replace the raw inventory columns by the fields of the instance's own entry."""
    raw = ["AWS:Application", "AWS:InstanceInformation", "AWS:WindowsUpdate"]
    kept = [c for c in df.columns if c.lower() not in {r.lower() for r in raw}]
    content = field_type(df.schema, ["AWS:InstanceInformation", "Content"])
    if not isinstance(content, T.MapType) or not isinstance(content.valueType, T.StructType):
        return df.select([quoted(c) for c in kept])
    holder = quoted(actual_name(df, "AWS:InstanceInformation")).getField("Content")
    own = F.try_element_at(holder, F.col("resourceId"))
    names = spread_names(kept, content.valueType.names)
    return df.select(
        *[quoted(c) for c in kept],
        *[own.getField(f).alias(n) for f, n in zip(content.valueType.names, names)],
    )


# ----------------------------------------------------------------------------
# Patch compliance
# ----------------------------------------------------------------------------


def patch_summary(item: Column) -> Column:
    """Typed summary entry of a compliance item."""
    return typed(item, f"$.Content.Patch.{SUMMARY_KEY}", COMPLIANCE_SUMMARY)


def patches(item: Column) -> Column:
    """Typed patches of a compliance item by key, without the summary entry."""
    blanks = ["Title", "Status", "PatchSeverity", "Classification", "PatchGroup"]
    parsed = typed(item, "$.Content.Patch", f"map<string,{PATCH}>")
    entries = F.map_filter(parsed, lambda k, _: k != SUMMARY_KEY)
    return F.transform_values(
        entries,
        lambda _, p: with_blanks_nulled(p, blanks)
        .withField("InstalledTime", _timestamp(p["InstalledTime"]))
        .withField("CVEIds", F.split(p["CVEIds"], ",")),
    )


def patch_compliance(df: DataFrame) -> DataFrame:
    """Summary and patches as typed columns instead of the raw item."""
    item = field_or_null(df, ["AWS:ComplianceItem"], _TEXT)
    out = df.withColumn("complianceSummary", patch_summary(item)).withColumn(
        "patches", patches(item)
    )
    held = actual_name(out, "AWS:ComplianceItem")
    if held is not None:
        out = out.select([quoted(c) for c in out.columns if c != held])
    return out.withColumn("resourceId", without_prefix(F.col("resourceId")))


def without_prefix(resource_id: Column) -> Column:
    return F.substring(resource_id, COMPLIANCE_ID_PREFIX + 1, 2**31 - 1)


# ----------------------------------------------------------------------------
# Every table
# ----------------------------------------------------------------------------


def name_from_tags(df: DataFrame) -> DataFrame:
    """``tagName`` from the Name tag, also used where a resource has no name."""
    return replace_column(
        df, "tagName", F.try_element_at(F.col("tags"), F.lit("Name"))
    ).withColumn("resourceName", F.coalesce("resourceName", "tagName"))


def any_name_tag(_: str, df: DataFrame) -> bool:
    """Whether any row has a Name tag; stops at the first one."""
    if not isinstance(field_type(df.schema, ["tags"]), T.MapType):
        return False
    tagged = df.filter(F.try_element_at(F.col("tags"), F.lit("Name")).isNotNull())
    return not tagged.select("tags").limit(1).isEmpty()


def dropping(name: str):
    return lambda df: df.select([quoted(c) for c in df.columns if c.lower() != name])


def _single(table: str, fn) -> dict:
    return {
        "dependencies": [table],
        "apply": lambda tables: {table: fn(tables[table])},
    }


BUILTIN = [
    Transform("ec2_instance_state", **_single("ec2_instance", instance_state)),
    Transform("s3_bucket", **_single("s3_bucket", bucket)),
    Transform(
        "vpc_endpoint_addresses",
        ["ec2_vpcendpoint", "ec2_networkinterface"],
        lambda t: {
            "ec2_vpcendpoint": endpoint_addresses(
                t["ec2_vpcendpoint"], t["ec2_networkinterface"]
            )
        },
    ),
    Transform(
        "iam_roles_policies",
        ["iam_role", "iam_user", "iam_group", "iam_policy", "aws_managed_policy"],
        principal_policies,
    ),
    Transform(
        "ssm_managedinstanceinventory",
        **_single("ssm_managedinstanceinventory", instance_inventory),
    ),
    Transform("ssm_patchcompliance", **_single("ssm_patchcompliance", patch_compliance)),
    Transform("sns_topic", **_single("sns_topic", topic)),
    Transform(
        "organizations_policy", **_single("organizations_policy", organization_policy)
    ),
]

BUILTIN_GLOBAL = [
    GlobalTransform(
        "name_from_tags",
        name_from_tags,
        any_name_tag,
        lambda: F.max(F.try_element_at(F.col("tags"), F.lit("Name")).isNotNull()),
    ),
    GlobalTransform("drop_tags_1", dropping("tags_1"), has_column("tags_1")),
    GlobalTransform("drop_arn_1", dropping("arn_1"), has_column("arn_1")),
]


def default_registry(**settings) -> Registry:
    return Registry(builtin=BUILTIN, builtin_global=BUILTIN_GLOBAL, **settings)
