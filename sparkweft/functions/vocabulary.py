"""Closed vocabularies and thresholds of the graph model."""

from __future__ import annotations

# Kinds, statuses, stop lists and limits that results depend on.
NODE_KINDS = "file def class table column config_file config_key iac_resource k8s_resource api_type api_message api_service api_operation api_schema ci_script app_command job_task job_queue sibling_stem role_feature".split()
EDGE_KINDS = "contains calls imports alters queries reads_config alters_col queries_col".split()
ADJACENCY_KINDS = "calls imports alters queries reads_config".split()
RESOURCE_KINDS = "alters queries reads_config".split()
ANALYSIS_STATUS = "failed incomplete ambiguous".split()
REFERENCE_STATUS = "ambiguous unresolved".split()
STOP_NAMES = (
    "main run setup teardown handle dispatch register wrap "
    "to_s to_str tostring str repr inspect format print println puts log warn debug trace "
    "equals eql? hash hashcode compareto compare cmp "
    "empty? blank? present? nil? valid? include? contains respond_to? key? has_key? "
    "to_a to_h to_sym to_i to_json "
    "map each collect select reject filter reduce merge flatten zip "
    "freeze dup clone tap then send call apply yield "
    "it its describe context before after around expect should assert refute let subject mock stub"
).split()
BUILTIN_TAILS = (
    "pop push shift unshift slice splice all any stringify keys values items entries has join split assign "
    "hasprefix hassuffix do newdecoder newencoder marshal unmarshal sprintf printf fprintf sprint sprintln close open dumps loads"
).split()
UBIQUITOUS_ROUTES = "/ /api /health /healthz /ping /status /login /logout /auth /me /user /users /index /home /data /v1 /api/v1 /graphql /admin /test /callback /{}".split()
SKIP_DIRS = ".git node_modules vendor dist build .next target __pycache__ .venv venv site-packages .svelte-kit out coverage".split()
STEM_FAMILY = {".go": "go", ".py": "python", ".pyi": "python", ".ts": "web", ".tsx": "web", ".js": "web", ".jsx": "web", ".svelte": "web", ".vue": "web", ".swift": "swift", ".rs": "rust"}
GENERIC_STEMS = (
    "app apps base common component components config constants default helper helpers index lib main mod page pages "
    "route routes schema service services store types util utils view views"
).split()
STEM_SKIP_DIRS = "__generated__ __mocks__ __snapshots__ __tests__ docs examples fixtures generated mocks snapshots spec specs test tests vendor".split()
STEM_SUFFIXES = ".component .components .container .controller .dao .handler .model .page .repo .repository .route .schema .service .store .view".split()
ROLE_TOKEN_STOP = (
    "api app base common component components config const constants content controller core data default detail display handler helper helpers "
    "hooks huma index internal layout lib main mod modal model module page pages provider route routes schema service services shared store "
    "test tests type types unit units util utils view views widget"
).split()
GO_ROLE_PAIRS = [("db", "duckdb"), ("db", "parser"), ("db", "postgres"), ("db", "server"), ("db", "sync"), ("duckdb", "server"), ("duckdb", "sync"), ("parser", "sync")]
MAX_DEFINERS = 3
HUB_DEGREE = 8
MAX_COMMIT_FILES = 40
MAX_GROUP_FILES = 8
MAX_BARE_FANOUT = 8
COCHANGE_SUPPORT, COCHANGE_LIFT, COCHANGE_STRENGTH = 5, 2.0, 0.3
UNIT_POLICY = {
    "a_xs": 2.0, "a_call": 0.35, "a_xdir": 0.3, "a_blast": 0.03, "a_hub": 0.15, "a_cc": 0.5,
    "cap_call": 3.0, "cap_xdir": 3.0, "cap_blast": 10.0, "cap_cc": 2.0, "cap_premium": 4.0,
}
SEVERITY = {"compatible": 0, "unknown": 1, "risky": 2, "breaking": 3}
VERDICTS = "serialize serialize_soft warn unknown clear".split()
#: Branches that may hold a lane without an open change.
RELEASE_BRANCH = r"^(main|master|develop|release([/-].*)?|hotfix([/-].*)?)$"
REBASE_CLASSES = "rebase_needed rebase_needed_observation".split()
