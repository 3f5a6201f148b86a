"""Word lists and enumerations of document decomposition."""

from typing import NamedTuple

# They must equal the decomposition rules for classes to agree.

ACTION_VERBS = (
    "create", "read", "write", "generate", "build", "deploy", "install",
    "run", "execute", "parse", "convert", "extract", "transform", "send",
    "fetch", "load", "save", "import", "export", "compile", "test",
    "validate", "format", "render", "process", "upload", "download",
    "delete", "update", "merge", "clone", "push", "pull", "configure",
    "setup", "initialize", "start", "stop", "monitor", "scan", "analyze",
    "optimize", "migrate", "implement", "define", "register", "publish",
    "subscribe", "connect", "disconnect", "authenticate", "authorize",
    "encrypt", "decrypt", "hash", "sign", "verify", "package", "bundle",
)

COMMAND_STARTERS = (
    "npm", "npx", "pip", "python", "python3", "bash", "sh", "node", "git", "docker", "curl", "cargo",
    "go", "dotnet", "mvn", "gradle", "uv", "pytest", "pnpm", "yarn", "cd", "rg", "wget",
)

RULE_KEYWORDS = (
    "must", "should", "avoid", "never", "always", "check", "verify",
    "ensure", "validate", "require", "prohibit", "restrict", "limit",
    "enforce", "mandatory", "forbidden", "do not", "don't",
)

DIRECTIVE_HEADING_KEYWORDS = (
    "best practice", "principle", "guideline", "strategy", "overview",
    "context", "philosophy", "standard", "convention", "pattern",
    "architecture", "design", "approach", "methodology", "recommendation",
)

ACTION_TYPE_KEYWORDS = (
    ("io_read", ("read", "load", "fetch", "import", "parse", "extract", "get", "scan", "analyze", "monitor")),
    ("io_write", ("write", "save", "export", "create", "generate", "output", "publish", "upload", "send", "push")),
    ("transform", ("transform", "convert", "format", "process", "modify", "merge", "optimize", "migrate", "refactor")),
    ("compute", ("calculate", "compute", "analyze", "evaluate", "compare", "hash", "encrypt", "decrypt")),
    ("external_call", ("api", "call", "request", "connect", "subscribe", "authenticate", "authorize")),
    ("state_change", ("install", "deploy", "configure", "setup", "initialize", "start", "stop", "update", "delete",
                      "register", "package", "bundle")),
    ("llm_inference", ("llm", "ai", "infer", "prompt", "chat")),
    ("await_input", ("input", "prompt", "ask", "wait", "await")),
)
DEFAULT_ACTION_TYPE = "transform"

DIRECTIVE_TYPE_KEYWORDS = (
    ("completion", ("complete", "done", "finish", "success", "result", "output", "deliver")),
    ("knowledge", ("know", "domain", "reference", "specification", "standard", "documentation", "resource")),
    ("principle", ("principle", "philosophy", "approach", "clean", "solid", "dry", "kiss", "yagni")),
    ("constraint", ("constraint", "limit", "restrict", "maximum", "minimum", "boundary", "threshold")),
    ("preference", ("prefer", "recommend", "favor", "default", "convention", "style")),
    ("strategy", ("strategy", "pattern", "method", "technique", "algorithm", "workflow", "process")),
)
DEFAULT_DIRECTIVE_TYPE = "knowledge"

CONDITION_TYPE_KEYWORDS = (
    ("permission_check", ("permission", "authorize", "auth", "access", "role")),
    ("existence_check", ("exist", "found", "available", "present", "missing")),
    ("type_check", ("type", "format", "schema", "json", "yaml")),
    ("range_check", ("range", "minimum", "maximum", "bounded")),
    ("threshold_check", ("threshold", "limit", "quota", "rate", "too many")),
    ("consistency_check", ("consistent", "consistency", "match", "align", "same")),
    ("state_check", ("state", "ready", "running", "stopped", "complete")),
)
DEFAULT_CONDITION_TYPE = "validation"

MARKS = "[❌✅🔴🟡🟢⚠️💡🎯📌]+"

ACTION_TYPES = (
    "transform", "io_read", "io_write", "compute", "external_call", "state_change", "llm_inference", "await_input",
)
CONDITION_TYPES = (
    "validation", "existence_check", "type_check", "range_check",
    "permission_check", "state_check", "consistency_check", "threshold_check",
)
DIRECTIVE_TYPES = ("completion", "knowledge", "principle", "constraint", "preference", "strategy")
LAYERS = ("claude_skill", "mcp_tool", "mcp_server_internal")
SCHEMA_VERSION = "2.4.0"
SKILL_ID = "^(claude|mcp)__[a-z_]+__[a-z_]+$"
RETURNS = ("boolean", "classification", "enum_value", "score")
RETURNS_AS_BOOLEAN = ("proceed_or_halt", "pass_fail", "true_false", "bool")
FAIL_ACTIONS = ("halt", "branch", "default_value", "error_throw", "retry", "escalate")
FAIL_ACTION_SYNONYMS = {
    "flag": "escalate",
    "warn": "escalate",
    "abort": "halt",
    "stop": "halt",
    "cancel": "halt",
    "skip": "branch",
    "continue": "branch",
    "transform": "branch",
}


class Limits(NamedTuple):
    """Elements per kind and commands of a document, characters that tell texts apart, and lengths of texts."""

    kinds: dict[str, int]
    commands: int
    start: int
    action_name: int
    text: int
    command: int
    condition: int


# The limits the published decomposition sets for one file. Nothing is cut unless a caller passes them.
FILE_LIMITS = Limits({"action": 15, "rule": 10, "directive": 10}, 5, 50, 60, 150, 100, 80)

EXPECTED_ACTION_TYPES = ("io_read", "io_write", "transform", "external_call", "await_input")

KEYWORD_PATTERNS = (
    ("file_operation", ("讀取", "寫入", "建立", "刪除", "read", "write", "create", "delete")),
    ("validation", ("驗證", "檢查", "確認", "validate", "check", "verify")),
    ("transformation", ("轉換", "處理", "解析", "convert", "transform", "parse")),
    ("output", ("輸出", "產生", "顯示", "output", "generate", "display")),
)

PATH_EXTENSIONS = (".json", ".md", ".mjs", ".py", ".sh", ".toml", ".ts", ".tsx", ".txt", ".yaml", ".yml")
FILE_KINDS = (
    ("template", "template", (".tmpl",)),
    ("script", "script", (".py", ".sh", ".mjs", ".js", ".ts")),
    ("config", None, (".json", ".yaml", ".yml", ".toml")),
    ("reference", None, (".md", ".txt")),
)
AUTHORITY_TOKENS = (
    ("network_call", ("curl ", "wget ", "http://", "https://")),
    ("system_mutation", ("rm ", "docker ", "git push", "npm install", "pip install", "chmod ", "chown ")),
    ("process_exec", ("python ", "python3 ", "bash ", "sh ", "node ", "npx ")),
    ("file_write", ("tee ", "cp ", "mv ", "touch ", "mkdir ")),
    ("read_only", ("rg ", "cat ", "ls ", "find ")),
)

KEYWORD_STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "will", "have", "has", "been", "being",
    "can", "should", "would", "use", "using", "used", "when", "where", "what", "which", "who", "how", "why",
    "all", "any", "some", "each", "every", "other", "into", "over", "such", "than", "then", "here", "there",
    "your", "our", "their", "its", "not", "but", "also", "only", "just", "more", "most", "very", "well",
    "may", "must", "shall",
)

GOAL_KEYWORDS = (
    ("discover", ("discover", "search", "find", "inventory", "dedup", "semantic", "lookup", "搜尋", "查找", "發現", "盤點")),
    ("ingest", ("import", "ingest", "parse", "convert", "normalize", "adopt", "匯入", "解析", "轉換", "正規化")),
    ("analyze", ("analyze", "analysis", "pattern", "cluster", "coverage", "分析", "模式", "聚類", "覆蓋")),
    ("govern", ("govern", "governance", "review", "approve", "reject", "audit", "risk",
                "治理", "審核", "核准", "拒絕", "稽核", "風險")),
    ("compare", ("compare", "comparison", "similar", "overlap", "diff", "比較", "相似", "重疊", "差異")),
    ("validate", ("validate", "verification", "verify", "test", "schema", "contract", "驗證", "測試", "規格", "契約")),
)
DEFAULT_GOAL = "discover"
PHASE_BY_GOAL = {"discover": "triage", "compare": "triage", "govern": "review", "validate": "review"}
DEFAULT_PHASE = "execution"

FIDELITY_WEIGHTS = {
    "semantic_similarity": 0.35,
    "structure_similarity": 0.25,
    "keyword_similarity": 0.20,
    "metadata_completeness": 0.20,
}
FIDELITY_THRESHOLDS = {
    "semantic_similarity": 0.85,
    "structure_similarity": 0.80,
    "keyword_similarity": 0.75,
    "metadata_completeness": 0.90,
    "overall": 0.80,
}
REQUIRED_METADATA = ("name", "description")
RECOMMENDED_METADATA = ("triggers", "globs")
REQUIRED_SHARE = 0.7
RECOMMENDED_SHARE = 0.3
