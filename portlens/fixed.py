"""Word lists, vocabularies, patterns and report phrases.

Everything in this module is a constant that results depend on. No logic here.
"""

from __future__ import annotations

# Commands whose usage is recorded, in detection order.
KNOWN_COMMANDS = (
    "find",
    "aggregate",
    "insert",
    "update",
    "delete",
    "findAndModify",
    "distinct",
    "count",
    "createIndexes",
    "dropIndexes",
    "listIndexes",
)

# Top-level keys that never name a command.
COMMAND_METADATA_KEYS = (
    "$db",
    "lsid",
    "readConcern",
    "writeConcern",
    "ordered",
    "txnNumber",
    "stmtId",
    "stmtIds",
    "autocommit",
    "startTransaction",
    "comment",
    "let",
    "maxTimeMS",
    "cursor",
    "bypassDocumentValidation",
    "apiVersion",
    "apiStrict",
    "apiDeprecationErrors",
)

# Command implied by the profiler operation.
COMMAND_BY_OPERATION = {
    "query": "find",
    "insert": "insert",
    "update": "update",
    "remove": "delete",
    "command": "unknown",
}

# Databases left out of fleet analysis.
SYSTEM_DATABASES = ("admin", "config", "local")

# Connection and monitoring commands dropped by the noise filter.
NOISE_COMMANDS = (
    "<unknown>",
    "authenticate",
    "buildinfo",
    "collstats",
    "connectionstatus",
    "dbstats",
    "endsessions",
    "getlog",
    "getparameter",
    "getshardmap",
    "getdefaultrwconcern",
    "grantrolestouser",
    "hello",
    "hostinfo",
    "ismaster",
    "listcollections",
    "listdatabases",
    "listindexes",
    "ping",
    "profile",
    "saslcontinue",
    "saslstart",
    "serverstatus",
)

# Log patterns.
COMMAND_LOG_PATTERN = r'"c"\s*:\s*"COMMAND"'
SLOW_QUERY_MARK = "Slow query"
LOG_NAME_PATTERN = r'"([A-Za-z][A-Za-z0-9_]*)"\s*:'

# Fixed value: owner of evidence that cannot be attributed to a database.
INSTANCE_LEVEL = "INSTANCE_LEVEL"

# Ordered enumerations, lowest first.
COMPLEXITY = ("Ignore", "Low", "Medium", "High", "Blocker")
PRIORITY = ("Low", "Medium", "High", "Critical")

# Vocabularies of the rule tables.
SCOPES = ("application_api", "likely_admin", "ignore")
SCOPE_CONFIDENCE = ("high", "medium", "low")
ACTIONS = (
    "direct_use",
    "verify_semantics",
    "minor_query_rewrite",
    "minor_update_rewrite",
    "rewrite_aggregation",
    "replace_operator",
    "review_index_management",
    "exclude_from_scope",
    "manual_assessment",
    "migration_blocker_review",
)
REVIEW_PRIORITY = ("P0", "P1", "P2")

# Necessity by scope.
NECESSITY = {
    "application_api": "Required",
    "likely_admin": "Conditional",
    "ignore": "Unnecessary",
}

# Features that block a migration when unsupported.
BLOCKER_CANDIDATES = (("stage", "$graphLookup"),)

# Command classes used when no rule matches.
NON_CORE_COMMANDS = ("clonecollectionascapped", "converttocapped", "filemd5")
OBJECT_MANAGEMENT_COMMANDS = ("dropindexes", "listindexes", "listcollections", "renamecollection")
LOW_COMMANDS = ("find", "insert", "update", "delete")
MEDIUM_COMMANDS = (
    "findandmodify",
    "distinct",
    "count",
    "bulkwrite",
    "createindexes",
    "create",
    "committransaction",
    "aborttransaction",
    "startsession",
    "endsessions",
)
HIGH_COMMANDS = ("aggregate", "mapreduce")
BLOCKER_COMMANDS = ("mapreduce",)
SECURITY_PREFIXES = ("create", "drop", "grant", "revoke", "updateuser", "updaterole")

# Administrative commands, lower-cased.
ADMIN_COMMANDS = (
    "abortmovecollection", "abortreshardcollection", "killop", "currentop", "listdatabases", "serverstatus", "dbstats", "collstats",
    "usersinfo", "replsetgetstatus", "connectionstatus", "buildinfo", "getparameter", "hostinfo", "ping", "top", "whatsmyuri", "getlog",
    "connpoolstats", "listcommands", "hello", "isdbgrid", "logout", "authenticate", "profile", "validate", "validatedbmetadata", "datasize",
    "addshard", "addshardtozone", "analyzeshardkey", "appendoplognote", "applyops", "balancercollectionstatus", "balancerstart",
    "balancerstatus", "balancerstop", "checkmetadataconsistency", "cleanupreshardcollection", "clearjumboflag", "collmod", "compact",
    "compactstructuredencryptiondata", "configurecollectionbalancing", "configurequeryanalyzer", "createrole", "createsearchindexes",
    "createuser", "dbhash", "dropallrolesfromdatabase", "dropallusersfromdatabase", "dropconnections", "dropdatabase", "droprole",
    "dropsearchindex", "dropuser", "enablesharding", "explain", "flushrouterconfig", "getauditconfig", "getclusterparameter",
    "getcmdlineopts", "getdefaultrwconcern", "getshardmap", "grantprivilegestorole", "grantrolestorole", "grantrolestouser",
    "invalidateusercache", "killallsessions", "killallsessionsbypattern", "killcursors", "killsessions", "listcollections", "listindexes",
    "listshards", "lockinfo", "logapplicationmessage", "logrotate", "mergeallchunksonshard", "mergechunks", "movechunk", "movecollection",
    "moveprimary", "moverange", "plancacheclear", "plancacheclearfilters", "plancachelistfilters", "plancachesetfilter", "reindex",
    "refinecollectionshardkey", "refreshsessions", "removeshard", "removeshardfromzone", "replsetabortprimarycatchup", "replsetfreeze",
    "replsetgetconfig", "replsetinitiate", "replsetmaintenance", "replsetreconfig", "replsetresizeoplog", "replsetstepdown",
    "replsetsyncfrom", "reshardcollection", "revokeprivilegesfromrole", "revokerolesfromrole", "revokerolesfromuser", "rolesinfo",
    "rotatecertificates", "setallowmigrations", "setauditconfig", "setclusterparameter", "setdefaultrwconcern",
    "setfeaturecompatibilityversion", "setindexcommitquorum", "setparameter", "setuserwriteblockmode", "shardcollection",
    "shardconnpoolstats", "shardingstate", "split", "transitionfromdedicatedconfigserver", "transitiontodedicatedconfigserver",
    "unsetsharding", "unshardcollection", "updaterole", "updatesearchindex", "updateuser", "updatezonekeyrange",
)
ADMIN_PREFIXES = ("createuser", "dropuser", "updateuser", "grant", "revoke", "shutdown", "setparameter", "fsync")
ADMIN_KEYWORDS = (
    "shard",
    "reshard",
    "balancer",
    "zone",
    "replset",
    "audit",
    "parameter",
    "clusterparameter",
    "defaultrwconcern",
    "featurecompatibility",
    "writeblock",
    "router",
    "chunk",
    "move",
    "configserver",
    "log",
    "lock",
    "certificate",
)

# Reasons given for commands that no rule covers. {source} and
# {target} are the platform names a caller passes in.
REASON_NON_CORE = "Specialized {source} maintenance command. It is usually not required to preserve application compatibility when migrating to {target}."
REASON_OBJECT_MANAGEMENT = "Object-management or inspection command that is only needed if the customer wants to preserve the same operational workflow."
REASON_LOW = "Core application CRUD command. If {vendor} supports it, migration is usually straightforward; if not, complexity rises significantly because business logic depends on it."
REASON_MEDIUM = "Application-facing command or application-managed object command with option or semantic differences that usually require verification during migration."
REASON_HIGH = "Application-facing command with complex processing semantics that usually requires significant rewrite or dedicated migration design."
REASON_ADMIN = "Administrative or operational {source} command. It is usually not necessary to preserve this behavior when migrating application workloads to {target}."
REASON_LIST = "Discovery or inspection command. It is usually not part of core application behavior during migration."
REASON_SECURITY = "Administrative DDL or security-management command. It is typically outside the application migration core path unless the customer explicitly requires the same workflow."
REASON_UNCLASSIFIED = "Command not explicitly classified. Treat it as application-facing by default and review its migration impact manually."
REASON_NO_RULE = "No baseline rule matched; treat this as an application-facing API and review it manually for migration impact."

# Reasons of the support adjustment.
ADJUST_EXCLUDED = "Administrative or operational item is excluded from application migration scope."
ADJUST_SUPPORTED = "{vendor} support status is Supported, so application code change is expected to be minimal."
ADJUST_BLOCKER = "{vendor} support status is Not Supported for a blocker-candidate API."
ADJUST_UNSUPPORTED = "{vendor} support status is Not Supported."
ADJUST_PARTIAL = "{vendor} support status is Partially Supported."
ADJUST_UNKNOWN = "{vendor} support status is Unknown, requiring manual validation."

# Reasons of necessity; %s is the feature.
NECESSITY_REQUIRED = "`%s` affects application-visible behavior or application-managed objects, so it should be considered part of the migration compatibility scope."
NECESSITY_CONDITIONAL = "`%s` is usually operational or tooling-related. Keep it only if the customer explicitly needs the same workflow after migration."
NECESSITY_OUTSIDE = "`%s` is mainly administrative or diagnostic and is normally outside the application migration scope."

# Phrases of the complexity explanation.
CLASS_LOW = "core application CRUD command"
CLASS_MEDIUM = "application-facing command with semantic differences"
CLASS_HIGH = "application-facing command with complex processing semantics"
CLASS_OTHER = "application-facing %s feature"
EXPLAIN_USAGE = " It is observed %d time(s) in the current workload."
EXPLAIN_EXCLUDED = "`%s` is a %s feature used mainly for database administration or operations, not for preserving application behavior during migration to {target}. Its migration complexity is therefore Ignore unless the customer explicitly wants to keep this operational workflow."
EXPLAIN_UNSUPPORTED = "`%s` is a %s. {target} marks it as Not Supported in the selected target combination, so application migration must redesign or replace this behavior. This drives the complexity to %s."
EXPLAIN_PARTIAL = "`%s` is a %s. {target} only partially supports it in the selected target combination, so migration requires semantic validation and likely localized rewrite. This results in %s complexity."
EXPLAIN_SUPPORTED = "`%s` is a %s and is supported by {target} in the selected target combination. Migration complexity remains %s because the application behavior is likely portable with limited change."
EXPLAIN_UNKNOWN = "`%s` is a %s, but its support status is currently Unknown for the selected target combination. Migration complexity is therefore kept conservative until the feature is reviewed manually."

# Priority thresholds and reasons.
PRIORITY_HIGH_USAGE = 10
PRIORITY_MEDIUM_USAGE = 20
PRIORITY_LOW_USAGE = 50
PRIORITY_SLOW_MS = 1000
HOTSPOT_USAGE = 20
PRIORITY_BLOCKER = "Blocker complexity item that requires dedicated remediation."
PRIORITY_HIGH_HOT = "High-complexity API with notable usage or latency."
PRIORITY_HIGH = "High-complexity API that likely needs rewrite effort."
PRIORITY_MEDIUM_HOT = "Medium-complexity API with notable usage or latency."
PRIORITY_MEDIUM = "Medium-complexity API requiring semantic validation or small changes."
PRIORITY_LOW_HOT = "Low-complexity API but widely used."
PRIORITY_LOW = "Low-complexity API with limited migration effort."
PRIORITY_OUTSIDE = "Outside main migration scope."

# Support texts and target versions.
VERSION_PATTERN = r"(?i)\b(\d+\s*(?:ai|c))\b"
DEFAULT_VERSIONS = ("19c", "26ai")
MODES = ("op", "no-op")
ANY_VERSION = ("", "any", "任意版本", "任意")
ANY_MODE = ("any", "任意部署方式", "任意")
NO_OP_MODE = ("noop", "no-op", "no_op")
NEGATIVE_PHRASES = ("not supported", "unsupported", "not applicable")
NEGATIVE_WORDS = ("no", "n/a", "na")

# Document identifiers in page text.
DOC_ID_PATTERN = r"\bF\d{5}-\d+\b"
MONTH_YEAR_PATTERN = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b"
MANUAL_VERSION_PATTERN = r"(?i)reflects version\s+(\d+\.\d+)\s+of "

# Outcomes of comparing two document versions.
CHANGE_FIRST = "first record or no earlier version"
CHANGE_UNREADABLE = "undecided: no current version found"
CHANGE_FOUND = "document version changed"
CHANGE_NONE = "document version unchanged"

# Reasons for a baseline entry without a support row.
UNCOVERED = "not_in_target_main_table"
SUPPORT_NOT_LOADED = "target_feature_support_not_loaded"
MAPPING_NOT_BUILT = "target_mapping_not_built"
