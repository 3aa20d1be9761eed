"""SQL for DuckDB that computes what the registered queries compute, straight from the tables.

The routes differ from the Spark ones: fields are never turned into CSV and parsed back,
histories are full outer joins of neighbouring snapshots, updates are CASE expressions.
"""

from __future__ import annotations

from reposift.samples import QUEUE_TEXTS

PROJECT_FIELDS = """fields as (
  select o_orderkey as id, 'cust' || o_custkey as owner, 'repo' || o_orderkey % 7 as repo,
    case o_orderkey % 5 when 0 then 'JavaScript' when 1 then 'TypeScript'
      when 2 then 'CoffeeScript' when 3 then 'Python' else 'javascript' end as language,
    strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' as day,
    epoch_ms(o_orderdate) as day_ms,
    o_orderpriority = '1-URGENT' as is_forked, o_orderstatus = 'F' as is_deleted,
    case when o_orderkey % 97 in (1, 2, 3, 4) then o_orderkey % 97 else 0 end as bad_kind,
    o_custkey
  from orders)"""

LANGUAGE_ID = """case language when 'JavaScript' then 0 when 'TypeScript' then 1
    when 'CoffeeScript' then 2 end"""

PROJECTS = f"""{PROJECT_FIELDS}, projects as (
  select owner, repo, {LANGUAGE_ID} as lang_id, is_deleted, is_forked, day_ms as created_ms
  from fields
  where bad_kind = 0 and language in ('JavaScript', 'TypeScript', 'CoffeeScript'))"""

_TEXTS = ", ".join(f"'{text}'" for text in QUEUE_TEXTS)
QUEUE = f"""queue as (
  select 'cust' || o_custkey as owner, 'repo' || o_orderkey as repo,
    case when o_orderstatus <> 'O' then cast(1528559497000 + o_orderkey % 3 as varchar) end
      as checkout_id,
    ([{_TEXTS}])[o_orderkey % 29 + 1] as result,
    o_orderstatus = 'F' as completed, o_orderkey
  from orders)"""

QUEUE_COLUMNS = "owner, repo, checkout_id, result, completed"

# The buckets of the texts, told by their numbers.
_BUCKETS = ", ".join(
    f"'{bucket}'" if bucket else f"left('{text}', 50)"
    for text, bucket in zip(
        QUEUE_TEXTS,
        (
            "503 Service Unavailable",
            "",
            "File name too long",
            "",
            "No such file or directory",
            "cannot open git-upload-pack",
            "git-upload-pack not permitted",
            "authentication not supported",
            "Duplicate stages not allowed",
            "Nul character not allowed",
            "No space left on device",
            "",
            "",
            "",
            "",
            "503 Service Unavailable",
            "No such file or directory",
        ),
    )
)
BUCKET = f"([{_BUCKETS}])[o_orderkey % 29 + 1]"

STATUS = """case when result is not null then 'ERROR' when completed then 'FINISHED'
    when checkout_id is not null then 'IN_PROGRESS' else 'PENDING' end"""

ERRORS = """errors as (
  select 'cust' || o_custkey as owner, 'repo' || o_orderkey as repo,
    case when l_linenumber = 7 then 'unknown'
      else left(repeat('part ' || l_partkey || ' ', 30), 254) end as error,
    cast(l_linenumber as bigint) * 1000000 + l_partkey as seq
  from lineitem join orders on l_orderkey = o_orderkey)"""

COMMITS = """commits as (
  select 'cust' || o_custkey as owner, 'repo' || o_orderkey % 7 as repo,
    md5(cast(o_orderkey as varchar)) as commit_id, md5('tree' || o_orderkey) as tree_id,
    epoch_ms(o_orderdate) // 1000 as commit_time_s, 'u' || o_custkey || '@x.org' as author,
    o_orderpriority as message, o_orderkey as seq
  from orders)"""

MESSAGES = f"""{COMMITS}, messages as (
  select owner as repo_owner, repo as repository, tree_id, author, commit_id, commit_time_s,
    message as long_message
  from commits)"""

_MONTH = "year(l_shipdate) * 12 + month(l_shipdate)"
SNAPSHOTS = f"""listed as (
  select l_suppkey, {_MONTH} as month, l_linenumber, max(l_partkey) as part
  from lineitem group by all),
months as (
  select l_suppkey, month, dense_rank() over (partition by l_suppkey order by month) as n,
    'c-' || l_suppkey || '-' || (month - 1) // 12 || lpad(cast((month - 1) % 12 + 1 as varchar), 2, '0')
      as commit_id,
    epoch_ms(make_date((month - 1) // 12, (month - 1) % 12 + 1, 1)::timestamp) // 1000
      as commit_time_s
  from (select distinct l_suppkey, month from listed)),
files as (
  select l_suppkey, n, l_linenumber, lpad(cast(part as varchar), 12, '0') as hash,
    'src/f' || l_linenumber || case l_linenumber % 4 when 0 then '.js' when 1 then '.ts'
      when 2 then '.JS' else '' end as path
  from listed join months using (l_suppkey, month)),
pairs as (
  select coalesce(new.l_suppkey, old.l_suppkey) as l_suppkey, coalesce(new.n, old.n + 1) as n,
    coalesce(new.path, old.path) as path, old.hash as old_hash, new.hash as new_hash
  from files new full outer join files old
    on new.l_suppkey = old.l_suppkey and new.path = old.path and new.n = old.n + 1),
changes as (
  select 'acme' as owner, 'supp' || l_suppkey as repo, commit_id, 't' || commit_id as tree_id,
    commit_time_s,
    case when old_hash is null then 'ADD' when new_hash is null then 'DELETE' else 'MODIFY' end
      as change_type,
    case when old_hash is not null then path end as old_path,
    case when new_hash is not null then path end as new_path, old_hash, new_hash, path
  from pairs join months using (l_suppkey, n)
  where old_hash is distinct from new_hash)"""

_READABLE = SNAPSHOTS.replace(
    "(select distinct l_suppkey, month from listed)",
    "(select distinct l_suppkey, month from listed where month % 12 <> 0)",
)

_RECORD = """select owner as repo_owner, repo as repository, tree_id, path as git_path,
    new_hash as hash_code, commit_id, commit_time_s from changes"""

DIFFS = """diffs as (
  select 'acme' as repo_owner, 'supp' || l_suppkey as repository, 't' || l_orderkey as tree_id,
    'src/f' || l_linenumber || case when l_orderkey % 5 = 2 then '.old' else '.new' end
      as git_path,
    case when l_orderkey % 5 <> 2 then 'g' || l_partkey end as hash_code,
    'c' || l_orderkey as commit_id, epoch_ms(l_shipdate) // 1000 as commit_time_s
  from lineitem)"""

ATTEMPTS = """attempts as (
  select user_id, event_type <> 'error' as ok,
    case when event_type = 'error' then props end as error,
    row_number() over (partition by user_id order by ts, event_id) as attempt
  from events)"""

BLOBS = "blobs as (select doc_id, md5(text) as hash_code, text as contents from documents)"
PAGES = "page_blobs as (select md5(html) as hash_code, html as contents from pages)"
LABELLED = """labelled as (
  select distinct hash_code from blobs where doc_id in (select doc_id from labels))"""
REQUESTS = """requests as (
  select hash_code from blobs union all select md5(text) from conversations)"""

FINISHED = "select md5(cast(o_orderkey as varchar)) from orders where o_orderstatus = 'F'"

FAILURES = """failures as (
  select 'cust' || o_custkey as owner, 'repo' || o_orderkey % 7 as repo,
    'cannot open git-upload-pack ' || min(o_orderkey) as error
  from orders where o_totalprice > 480000 group by all)"""
BATCH = """batch as (
  select distinct owner, repo from commits order by owner, repo limit 2000)"""

_PATHS = "select page_id, regexp_replace(url, '[?#].*', '') as path from pages"

_PROJECTS_TOP = "select * from projects order by all limit"
_PENDING = "not completed and result is null and checkout_id is null"
_TOKEN = "'1700000000000'"
_CLAIM = f"""with {QUEUE}, batch as (
  select owner, repo, true as hit from queue where {_PENDING} order by owner, repo limit 1000)
select owner, repo, case when hit then {_TOKEN} else checkout_id end as checkout_id, result,
  completed
from queue left join batch using (owner, repo)"""
_LOADED = """select owner, repo, cast(null as varchar) as checkout_id,
  cast(null as varchar) as result, false as completed"""
_FINAL_PAIRS = f"""{_LOADED}
from (select distinct owner, repo from projects where not is_deleted and not is_forked)"""
_NUMBERED = "row_number() over (partition by owner, repo order by commit_time_s, {}) as position"
_RESET = "o_orderkey % 29 not in (2, 3, 8, 9) and result is not null"

# Claimed, then marked with the error of line 7 and completed, then one kind of error reset.
CHANGED_QUEUE = f"""{QUEUE}, batch as (
  select owner, repo, true as hit from queue where {_PENDING} order by owner, repo limit 1000),
hits as (select distinct l_orderkey from lineitem where l_linenumber = 7),
marked as (
  select owner, repo, o_orderkey, l_orderkey is not null as marked,
    case when l_orderkey is not null then {_TOKEN} when hit then {_TOKEN} else checkout_id end
      as checkout_id,
    result is not null as known,
    case when l_orderkey is not null then coalesce(result, 'unknown') else result end as result,
    completed or l_orderkey is not null as completed
  from queue left join batch using (owner, repo) left join hits on l_orderkey = o_orderkey),
changed as (
  select owner, repo, o_orderkey, known,
    case when not gone then checkout_id end as checkout_id,
    case when not gone then result end as result, completed and not gone as completed
  from (select *, coalesce(known and o_orderkey % 29 = 1, false) as gone from marked))"""

ORACLES: dict[str, str] = {
    "scan_project_lines": f"""with {PROJECT_FIELDS}, dated as (
  select *, case when bad_kind = 3 then '2012-13-45 00:00:00' else day end as created_at
  from fields)
select id || ',"https://api.github.com/repos/' || owner
  || case when bad_kind = 1 then '' else '/' || repo end || '",' || id || ',"' || repo || '",'
  || case when bad_kind = 4 then '"quoted" text' else '"says ""hi"", twice"' end || ',"'
  || language || '","' || created_at || '",'
  || case when is_forked then cast(o_custkey as varchar) else chr(92) || 'N' end || ','
  || case when bad_kind = 2 then 'x' when is_deleted then '1' else '0' end || ','
  || created_at as value
from dated""",
    "parse_projects": f"with {PROJECTS} select * from projects",
    "parse_projects_of_language": f"with {PROJECTS} select * from projects where lang_id = 1",
    "rejected_lines": f"""with {PROJECT_FIELDS}, judged as (
  select id, case when bad_kind = 4 then 'not a CSV record'
    when bad_kind = 1 then 'no owner and repository in the url'
    when language in ('Python', 'javascript') then 'language not wanted'
    when bad_kind = 2 then 'deleted is not an integer'
    when bad_kind = 3 then 'created_at is not a date' end as error
  from fields)
select * from judged where error is not null""",
    "url_owner_repo": f"""with {PROJECT_FIELDS}
select id, owner, case when bad_kind <> 1 then repo end as repo from fields
where bad_kind <> 4""",
    "language_id": f"""with {PROJECT_FIELDS}
select id, {LANGUAGE_ID} as lang_id from fields where bad_kind <> 4""",
    "deleted_flag": f"""with {PROJECT_FIELDS}
select id, case when bad_kind <> 2 then is_deleted end as is_deleted from fields
where bad_kind <> 4""",
    "forked_flag": f"with {PROJECT_FIELDS} select id, is_forked from fields where bad_kind <> 4",
    "created_ms": f"""with {PROJECT_FIELDS}
select id, case when bad_kind <> 3 then day_ms end as created_ms from fields
where bad_kind <> 4""",
    "filter_deleted": f"with {PROJECTS} select * from projects where not is_deleted",
    "filter_forked": f"with {PROJECTS} select * from projects where not is_forked",
    "filter_top_n": f"with {PROJECTS} {_PROJECTS_TOP} 500",
    "filter_top_n_in_parallel": f"with {PROJECTS} {_PROJECTS_TOP} 500",
    "apply_project_filters": f"""with {PROJECTS}
select * from projects where not is_deleted and not is_forked order by all limit 300""",
    "top_n_before_distinct": f"""with {PROJECTS}
select distinct owner, repo from ({_PROJECTS_TOP} 300)""",
    "project_pairs": f"with {PROJECTS} select distinct owner, repo from projects",
    "load_project_queue": f"with {PROJECTS} {_FINAL_PAIRS}",
    "load_project_queue_status": f"""with {PROJECTS}
select 'PENDING' as status, count(distinct (owner, repo)) as count
from projects where not is_deleted and not is_forked""",
    "stream_project_lines": f"with {PROJECTS} {_FINAL_PAIRS}",
    "scan_queue": f"with {QUEUE} select {QUEUE_COLUMNS} from queue",
    "load_queue": f"with {PROJECT_FIELDS} {_LOADED} from (select distinct owner, repo from fields)",
    "load_queue_ignoring_case": f"""with {PROJECT_FIELDS}
{_LOADED} from (select distinct upper(owner) as owner, upper(repo) as repo from fields)""",
    "load_queue_merging": f"""with {QUEUE}, {ERRORS}, {PROJECT_FIELDS}, pairs as (
  select owner, repo from errors union select owner, repo from fields)
select {QUEUE_COLUMNS} from queue
union all
{_LOADED} from pairs
where not exists (
  select 1 from queue where queue.owner = pairs.owner and queue.repo = pairs.repo)""",
    "queue_status": f"with {QUEUE} select owner, repo, {STATUS} as status from queue",
    "error_bucket": f"with {QUEUE} select owner, repo, {BUCKET} as bucket from queue",
    "error_text": f"with {ERRORS} select * from errors",
    "pending": f"with {QUEUE} select {QUEUE_COLUMNS} from queue where {_PENDING}",
    "in_progress": f"""with {QUEUE} select {QUEUE_COLUMNS} from queue
where not completed and result is null and checkout_id is not null""",
    "failed": f"with {QUEUE} select {QUEUE_COLUMNS} from queue where result is not null",
    "like_any": f"with {QUEUE} select owner, repo, result from queue where {_RESET}",
    "like_any_ignoring_case": f"with {QUEUE} select owner, repo, result from queue where {_RESET}",
    "status_counts": f"""with {QUEUE}
select {STATUS} as status, count(*) as count from queue group by 1""",
    "progress_by_token": f"""with {QUEUE}
select checkout_id, count(*) as count from queue
where not completed and result is null and checkout_id is not null group by 1""",
    "error_counts": f"""with {QUEUE}
select {BUCKET} as bucket, count(*) as count from queue where result is not null group by 1""",
    "queue_report": f"""with {QUEUE}
select 0 as section, 'TIME' as status, '2018-06-09 15:51:37' as details,
  cast(0 as bigint) as count
union all
select 1, {STATUS}, '', count(*) from queue group by 2
union all
select 2, 'IN_PROGRESS', checkout_id, count(*) from queue
where not completed and result is null and checkout_id is not null group by 3
union all
select 3, 'ERROR', {BUCKET}, count(*) from queue where result is not null group by 3""",
    "claim": _CLAIM,
    "claim_in_parallel": _CLAIM,
    "claim_all": f"""with {QUEUE}
select owner, repo, case when {_PENDING} then {_TOKEN} else checkout_id end as checkout_id,
  result, completed
from queue""",
    "claimed_batch": f"""with {QUEUE}
select owner, repo from queue where {_PENDING} order by owner, repo limit 1000""",
    "batch_is_empty": f"with {QUEUE} select count(*) = 0 as is_empty from queue where {_PENDING}",
    "mark_completed": f"""with {QUEUE}, hits as (select distinct l_orderkey from lineitem)
select owner, repo, case when l_orderkey is null then checkout_id else {_TOKEN} end
    as checkout_id,
  result, completed or l_orderkey is not null as completed
from queue left join hits on l_orderkey = o_orderkey""",
    "mark_error": f"""with {QUEUE}, {ERRORS}, firsts as (
  select distinct on (owner, repo) owner, repo, error from errors
  order by owner, repo, seq, error)
select owner, repo,
  case when result is null and error is not null then null else checkout_id end as checkout_id,
  coalesce(result, error) as result, completed
from queue left join firsts using (owner, repo)""",
    "reset_errors": f"""with {QUEUE}, judged as (
  select *, coalesce({_RESET}, false) as hit from queue)
select owner, repo, case when not hit then checkout_id end as checkout_id,
  case when not hit then result end as result, completed and not hit as completed
from judged""",
    "release_incomplete": f"""with {QUEUE}
select owner, repo, case when completed then checkout_id end as checkout_id, result, completed
from queue""",
    "release_stale": f"""with {QUEUE}
select owner, repo, case when not completed and checkout_id not in ('1528559497001') then null
    else checkout_id end as checkout_id, result, completed
from queue""",
    "changed_queue": f"with {CHANGED_QUEUE} select {QUEUE_COLUMNS} from changed",
    "changed_queue_compacted": f"""with {CHANGED_QUEUE}
select owner, repo,
  case when completed or checkout_id in ({_TOKEN}, '1528559497000') then checkout_id end
    as checkout_id,
  result, completed
from changed""",
    "stored_report": f"""with {CHANGED_QUEUE}
select 0 as section, 'TIME' as status, '2018-06-09 15:51:37' as details,
  cast(0 as bigint) as count
union all
select 1, {STATUS}, '', count(*) from changed group by 2
union all
select 2, 'IN_PROGRESS', checkout_id, count(*) from changed
where not completed and result is null and checkout_id is not null group by 3
union all
select 3, 'ERROR', case when known then {BUCKET} else 'unknown' end, count(*) from changed
where result is not null group by 3""",
    "claims_of_two": f"""with {QUEUE}, {PROJECTS}, loaded as (
  select owner, repo, row_number() over (order by owner, repo) as place
  from (select distinct owner, repo from queue)),
listed as (
  select distinct owner, repo from projects where not is_deleted and not is_forked
  and not exists (
    select 1 from loaded where loaded.owner = projects.owner and loaded.repo = projects.repo)),
waiting as (
  select owner, repo from loaded where place > 400 union all select owner, repo from listed),
second as (select owner, repo from waiting order by owner, repo limit 400)
select owner, repo,
  case when place <= 400 then {_TOKEN} when second.owner is not null then '1700000000001' end
    as checkout_id,
  cast(null as varchar) as result, false as completed
from (select * from loaded union all select *, 401 from listed)
  left join second using (owner, repo)""",
    "log_errors": f"""with {ERRORS}
select owner, repo, error, cast({_TOKEN} as bigint) as run from errors""",
    "scan_commits": f"with {COMMITS} select *, {_NUMBERED.format('commit_id')} from commits",
    "scan_commits_in_log_order": f"""with {COMMITS}
select *, {_NUMBERED.format('seq')} from commits""",
    "scan_commits_of_large_repos": f"""with {COMMITS}
select *, {_NUMBERED.format('commit_id')} from commits""",
    "messages_of_readable_commits": f"""with {MESSAGES}
select * from messages where long_message <> '5-LOW'""",
    "file_history_with_unreadable_commits": f"with {_READABLE} {_RECORD}",
    "commit_messages": f"with {MESSAGES} select * from messages",
    "change_records": f"with {DIFFS} select * from diffs",
    "file_extension": f"""with paths as ({_PATHS})
select page_id, path, regexp_extract(path, '\\.([^./]*)$', 1) as extension from paths""",
    "checkout_owner_repo": f"with {COMMITS} select commit_id, owner, repo from commits",
    "filter_extensions": f"""with {SNAPSHOTS}
select 'acme' as owner, 'supp' || l_suppkey as repo, commit_id,
  'src/f' || l_linenumber || case l_linenumber % 4 when 0 then '.js' when 1 then '.ts'
    else '.JS' end as path,
  lpad(cast(l_partkey as varchar), 12, '0') as hash_code
from (select *, {_MONTH} as month from lineitem) join months using (l_suppkey, month)
where l_linenumber % 4 <> 3""",
    "filter_extensions_case_sensitive": f"""with {SNAPSHOTS}
select 'acme' as owner, 'supp' || l_suppkey as repo, commit_id,
  'src/f' || l_linenumber || case l_linenumber % 4 when 0 then '.js' else '.ts' end as path,
  lpad(cast(l_partkey as varchar), 12, '0') as hash_code
from (select *, {_MONTH} as month from lineitem) join months using (l_suppkey, month)
where l_linenumber % 4 in (0, 1)""",
    "snapshot_changes": f"with {SNAPSHOTS} select * exclude (path) from changes",
    "file_history": f"with {SNAPSHOTS} {_RECORD}",
    "file_history_of_large_repos": f"with {SNAPSHOTS} {_RECORD}",
    "file_history_of_extensions": f"""with {SNAPSHOTS} {_RECORD}
where lower(path) like '%.js' or lower(path) like '%.ts'""",
    "resolve_attempts": f"""with {ATTEMPTS}
select distinct on (user_id) user_id, cast(attempt as integer) as attempt, ok, error
from attempts where attempt <= 3
order by user_id, ok desc, case when ok then attempt else -attempt end""",
    "failed_attempts": f"""with {ATTEMPTS}
select user_id, cast(attempt as integer) as attempt, ok, error
from attempts where attempt = 1 and not ok""",
    "store_records": f"with {DIFFS} select *, cast({_TOKEN} as bigint) as run from diffs",
    "all_runs": f"""with {BLOBS}, {PAGES}
select hash_code, contents, cast(1 as bigint) as run from blobs
union all
select hash_code, contents, cast(2 as bigint) from blobs
union all
select hash_code, contents, cast(2 as bigint) from page_blobs""",
    "read_split": f"""with {BLOBS}, {PAGES}
select hash_code, contents from blobs union select hash_code, contents from page_blobs""",
    "read_split_of_changes": f"""with {DIFFS}
select distinct repo_owner, repository, git_path, hash_code, commit_id from diffs""",
    "read_split_latest": f"""with {MESSAGES}
select commit_id, author,
  long_message || case when commit_id in ({FINISHED}) then ', amended' else '' end
    as long_message
from messages""",
    "existing_hashes": f"with {BLOBS} select distinct hash_code from blobs",
    "consolidate": f"""with {BLOBS}, {PAGES}
select *, cast(3 as bigint) as run from (
  select hash_code, contents from blobs union select hash_code, contents from page_blobs)""",
    "consolidate_after_a_small_run": f"""with {BLOBS}, {PAGES}
select hash_code, contents from blobs
union select hash_code, contents from page_blobs where contents like '%/de/%'""",
    "consolidate_latest": f"""with {MESSAGES}
select * exclude (long_message),
  long_message || case when commit_id in ({FINISHED}) then ', amended' else '' end
    as long_message,
  cast(3 as bigint) as run
from messages""",
    "lookup_contents": f"""with {BLOBS}, {REQUESTS}
select hash_code, contents,
  case when contents is null then 'missing object ' || hash_code end as error
from requests left join (select distinct hash_code, contents from blobs) using (hash_code)""",
    "found_contents": f"""with {BLOBS}, {REQUESTS}
select hash_code, contents
from requests join (select distinct hash_code, contents from blobs) using (hash_code)""",
    "missing_contents": f"""with {BLOBS}, {REQUESTS}
select hash_code from requests where hash_code not in (select hash_code from blobs)""",
    "new_hashes": f"""with {BLOBS}, {LABELLED}
select * from blobs where hash_code not in (select hash_code from labelled)""",
    "dedup_latest": f"""with {BLOBS}
select max(doc_id) as doc_id, hash_code, contents from blobs group by hash_code, contents""",
    "crawl_commit_messages": f"""with {MESSAGES}, {FAILURES}
select messages.*, cast({_TOKEN} as bigint) as run
from messages
where not exists (
  select 1 from failures where failures.owner = repo_owner and failures.repo = repository)""",
    "crawl_commit_messages_in_batch": f"""with {MESSAGES}, {FAILURES}, {BATCH}
select messages.*, cast({_TOKEN} as bigint) as run
from messages join batch on repo_owner = batch.owner and repository = batch.repo
where not exists (
  select 1 from failures where failures.owner = repo_owner and failures.repo = repository)""",
    "crawl_commit_messages_marks": f"""with {COMMITS}, {FAILURES}, {BATCH}
select owner, repo, case when batch.owner is not null then {_TOKEN} end as checkout_id,
  case when batch.owner is not null then error end as result,
  batch.owner is not null as completed
from (select distinct owner, repo from commits)
  left join batch using (owner, repo) left join failures using (owner, repo)""",
    "crawl_file_history": f"""with {SNAPSHOTS}
select *, cast({_TOKEN} as bigint) as run from ({_RECORD})
where lower(git_path) like '%.js' or lower(git_path) like '%.ts'""",
    "crawl_file_contents": f"""with {BLOBS}, {LABELLED}
select distinct hash_code, cast({_TOKEN} as bigint) as run, contents
from blobs where doc_id % 4 <> 3 and hash_code not in (select hash_code from labelled)""",
    "crawl_file_contents_misses": f"""with {BLOBS}, {LABELLED}
select distinct hash_code, 'missing object ' || hash_code as error, cast({_TOKEN} as bigint) as run
from blobs where doc_id % 4 <> 3 and hash_code not in (select hash_code from labelled)""",
    "crawl_of_attempts": f"""with {COMMITS}, {ATTEMPTS}, outcome as (
  select distinct on (user_id) user_id, ok, error from attempts where attempt <= 2
  order by user_id, ok desc, case when ok then attempt else -attempt end)
select owner, repo, {_TOKEN} as checkout_id,
  case when not ok then substring(coalesce(error, 'unknown'), 1, 254) end as result,
  true as completed
from (select distinct owner, repo from commits)
  left join outcome on owner = 'cust' || user_id""",
    "drain_after_crash": f"""with {COMMITS}
select 'FINISHED' as status, count(distinct (owner, repo)) as count from commits
union all
select 'STORED', count(*) from commits""",
    "batch_is_empty_when_done": f"with {QUEUE} select count(*) = 0 as is_empty from queue where false",
    "drain": f"""with {COMMITS}
select 'FINISHED' as status, count(distinct (owner, repo)) as count from commits
union all
select 'STORED', count(*) from commits""",
}
