"""Built-in rule table, as CSV text."""

from __future__ import annotations

# The built-in rules, one CSV line each.
RULES_VERSION = "v1.1"
RULES_CSV = """\
feature_name,feature_type,migration_scope,scope_confidence,needs_review,default_complexity,complexity_reason,recommended_action,review_priority,notes,enabled
find,command,application_api,high,false,Low,Core read API and usually directly portable,direct_use,P0,,true
insert,command,application_api,high,false,Low,Core write API and usually directly portable,direct_use,P0,,true
update,command,application_api,high,false,Low,Core write API but final complexity can depend on update operators,minor_update_rewrite,P0,,true
delete,command,application_api,high,false,Low,Core delete API and usually directly portable,direct_use,P0,,true
findAndModify,command,application_api,high,false,Medium,Return semantics and option handling often need verification,verify_semantics,P0,,true
distinct,command,application_api,high,false,Medium,Needs validation for result semantics and performance,verify_semantics,P1,,true
count,command,application_api,high,false,Medium,Legacy usage often needs query-side adjustment,minor_query_rewrite,P1,,true
aggregate,command,application_api,high,false,High,Pipeline complexity depends on stages and expressions,rewrite_aggregation,P0,,true
bulkWrite,command,application_api,high,false,Medium,Batch write semantics should be verified as part of application compatibility,verify_semantics,P1,,true
create,command,application_api,medium,true,Medium,Application-managed collection creation may need to be preserved if the application initializes objects at runtime,verify_semantics,P1,,true
createIndexes,command,application_api,medium,true,Medium,Application-managed index creation is usually necessary to preserve application startup and query behavior,review_index_management,P0,,true
commitTransaction,command,application_api,high,false,Medium,Transaction lifecycle command and part of application correctness,verify_semantics,P0,,true
abortTransaction,command,application_api,high,false,Medium,Transaction lifecycle command and part of application correctness,verify_semantics,P0,,true
startSession,command,application_api,high,false,Medium,Session lifecycle can affect application transaction behavior,verify_semantics,P1,,true
endSessions,command,application_api,medium,false,Medium,Session cleanup behavior may need verification if explicitly used by the application,verify_semantics,P2,,true
dropIndexes,command,likely_admin,high,false,Ignore,Index cleanup is only needed if the customer wants to preserve the same operational workflow,exclude_from_scope,P2,,true
listIndexes,command,likely_admin,high,false,Ignore,Index inspection is usually tooling or operational behavior,exclude_from_scope,P2,,true
listCollections,command,likely_admin,high,false,Ignore,Collection discovery is usually tooling or operational behavior outside core application compatibility,exclude_from_scope,P2,,true
renameCollection,command,likely_admin,medium,true,Ignore,Collection rename is usually a migration or operational task rather than an application compatibility requirement,exclude_from_scope,P2,,true
cloneCollectionAsCapped,command,ignore,high,false,Ignore,Specialized collection maintenance command outside normal application compatibility scope,exclude_from_scope,P2,,true
convertToCapped,command,ignore,high,false,Ignore,Specialized collection maintenance command outside normal application compatibility scope,exclude_from_scope,P2,,true
filemd5,command,ignore,medium,false,Ignore,Specialized GridFS or maintenance command that is usually not required for application compatibility,exclude_from_scope,P2,,true
listDatabases,command,ignore,high,false,Ignore,Administrative discovery command outside migration scope,exclude_from_scope,P2,,true
serverStatus,command,ignore,high,false,Ignore,Operational diagnostic command outside migration scope,exclude_from_scope,P2,,true
dbStats,command,ignore,high,false,Ignore,Administrative command outside migration scope,exclude_from_scope,P2,,true
collStats,command,ignore,high,false,Ignore,Administrative command outside migration scope,exclude_from_scope,P2,,true
usersInfo,command,ignore,high,false,Ignore,Administrative security inspection command outside migration scope,exclude_from_scope,P2,,true
replSetGetStatus,command,ignore,high,false,Ignore,Operational replica set status command outside migration scope,exclude_from_scope,P2,,true
connectionStatus,command,ignore,high,false,Ignore,Operational connection inspection command outside migration scope,exclude_from_scope,P2,,true
buildInfo,command,ignore,high,false,Ignore,Diagnostic server capability command outside migration scope,exclude_from_scope,P2,,true
getParameter,command,ignore,high,false,Ignore,Operational server parameter inspection outside migration scope,exclude_from_scope,P2,,true
hostInfo,command,ignore,high,false,Ignore,Operational host inspection outside migration scope,exclude_from_scope,P2,,true
ping,command,ignore,high,false,Ignore,Health-check command outside migration scope,exclude_from_scope,P2,,true
$match,stage,application_api,high,false,Low,Simple filtering stage,direct_use,P1,,true
$project,stage,application_api,high,false,Low,Projection stage is usually straightforward,direct_use,P1,,true
$sort,stage,application_api,high,false,Low,Sorting stage is usually straightforward,direct_use,P1,,true
$limit,stage,application_api,high,false,Low,Simple limiting stage,direct_use,P2,,true
$skip,stage,application_api,high,false,Low,Simple pagination stage,direct_use,P2,,true
$unwind,stage,application_api,high,false,Medium,Array expansion often needs semantic verification,verify_semantics,P1,,true
$addFields,stage,application_api,high,false,Medium,Derived field logic depends on expressions,verify_semantics,P1,,true
$set,stage,application_api,high,false,Medium,Derived field logic depends on expressions,verify_semantics,P1,,true
$unset,stage,application_api,high,false,Medium,Field removal inside pipeline needs validation,verify_semantics,P1,,true
$count,stage,application_api,high,false,Medium,Count stage semantics need validation,verify_semantics,P1,,true
$group,stage,application_api,high,false,High,Aggregation grouping logic often needs rewrite,rewrite_aggregation,P0,,true
$lookup,stage,application_api,high,false,High,Join-like semantics are a common migration hotspot,rewrite_aggregation,P0,,true
$facet,stage,application_api,high,false,High,Multi-branch pipeline logic is usually costly to migrate,rewrite_aggregation,P0,,true
$merge,stage,application_api,medium,true,High,Write-back pipeline semantics require dedicated review,manual_assessment,P0,,true
$out,stage,application_api,medium,true,High,Materialization stage requires dedicated review,manual_assessment,P0,,true
$bucketAuto,stage,application_api,high,false,High,Auto-bucketing semantics often need redesign,rewrite_aggregation,P1,,true
$graphLookup,stage,application_api,high,false,Blocker,Recursive graph traversal needs dedicated assessment,migration_blocker_review,P0,,true
$eq,operator,application_api,high,false,Low,Simple comparison operator,direct_use,P2,,true
$ne,operator,application_api,high,false,Low,Simple comparison operator,direct_use,P2,,true
$gt,operator,application_api,high,false,Low,Simple comparison operator,direct_use,P2,,true
$gte,operator,application_api,high,false,Low,Simple comparison operator,direct_use,P2,,true
$lt,operator,application_api,high,false,Low,Simple comparison operator,direct_use,P2,,true
$lte,operator,application_api,high,false,Low,Simple comparison operator,direct_use,P2,,true
$in,operator,application_api,high,false,Low,Common membership filter,direct_use,P2,,true
$nin,operator,application_api,medium,false,Medium,Negative set filter needs validation,verify_semantics,P2,,true
$and,operator,application_api,high,false,Low,Common logical operator,direct_use,P2,,true
$or,operator,application_api,high,false,Low,Common logical operator,direct_use,P2,,true
$not,operator,application_api,medium,false,Medium,Negation semantics need testing,verify_semantics,P1,,true
$nor,operator,application_api,medium,false,Medium,Negation semantics need testing,verify_semantics,P1,,true
$exists,operator,application_api,medium,false,Medium,Field existence semantics need validation,verify_semantics,P1,,true
$regex,operator,application_api,medium,false,Medium,Regex compatibility and performance require review,verify_semantics,P1,,true
$elemMatch,operator,application_api,medium,false,Medium,Array matching semantics require testing,verify_semantics,P1,,true
$size,operator,application_api,medium,false,Medium,Array cardinality checks need validation,verify_semantics,P1,,true
$all,operator,application_api,medium,false,Medium,Array containment semantics need validation,verify_semantics,P1,,true
$set,operator,application_api,high,false,Low,Common update operator,direct_use,P1,,true
$unset,operator,application_api,high,false,Low,Common update operator,direct_use,P1,,true
$inc,operator,application_api,high,false,Low,Common update operator,direct_use,P1,,true
$push,operator,application_api,medium,false,Medium,Array mutation behavior needs review,minor_update_rewrite,P1,,true
$pull,operator,application_api,medium,false,Medium,Array mutation behavior needs review,minor_update_rewrite,P1,,true
$addToSet,operator,application_api,medium,false,Medium,Array uniqueness mutation needs review,minor_update_rewrite,P1,,true
$rename,operator,application_api,medium,true,High,Schema-shaping updates often need redesign,replace_operator,P0,,true
$sum,expression,application_api,high,false,Low,Common aggregate expression,direct_use,P2,,true
$avg,expression,application_api,high,false,Low,Common aggregate expression,direct_use,P2,,true
$min,expression,application_api,high,false,Low,Common aggregate expression,direct_use,P2,,true
$max,expression,application_api,high,false,Low,Common aggregate expression,direct_use,P2,,true
$cond,expression,application_api,medium,false,Medium,Conditional expression needs verification,verify_semantics,P1,,true
$ifNull,expression,application_api,medium,false,Medium,Null-handling semantics need testing,verify_semantics,P1,,true
$concat,expression,application_api,medium,false,Medium,String expression behavior needs review,verify_semantics,P1,,true
$dateToString,expression,application_api,medium,false,Medium,Date formatting semantics need testing,verify_semantics,P1,,true
$map,expression,application_api,high,false,High,Collection transformation logic is migration-heavy,rewrite_aggregation,P0,,true
$filter,expression,application_api,high,false,High,Collection transformation logic is migration-heavy,rewrite_aggregation,P0,,true
$reduce,expression,application_api,high,false,High,Stateful array reduction often needs redesign,rewrite_aggregation,P0,,true
$regexMatch,expression,application_api,high,false,High,Regex expression semantics and performance require review,manual_assessment,P1,,true
$setField,expression,application_api,high,false,High,Dynamic field manipulation often needs redesign,manual_assessment,P0,,true
"""
