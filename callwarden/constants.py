"""Word lists, names and limits that results must agree on.

Everything in this file is data.  The code that interprets it lives elsewhere.
"""

# --- injection heuristics (names in reporting order) -------------------------
HIDDEN_TEXT = "hidden-text"
ROLE_HIJACK = "role-hijack"
CONCEALMENT = "concealment"
INSTRUCTION_OVERRIDE = "instruction-override"
EXFILTRATION = "exfiltration"
HEURISTICS = [HIDDEN_TEXT, ROLE_HIJACK, CONCEALMENT, INSTRUCTION_OVERRIDE, EXFILTRATION]
CLASSIFIER_HEURISTIC = "llm-classifier"

# Phrases looked for in normalised text (lower case, single spaces).
ROLE_HIJACK_PHRASES = [
    "you are now", "you are no longer", "from now on you", "pretend you are", "pretend to be",
    "your new role", "your new instructions", "new system prompt", "system prompt",
    "developer mode", "im start",
]
CONCEALMENT_PHRASES = [
    "do not tell the user", "don t tell the user", "without telling the user",
    "without informing the user", "without the user knowing", "do not mention this",
    "do not mention it", "do not reveal", "keep this secret", "keep this to yourself",
    "this message is not for the user",
]

# Trigger and target words that fire when they stand within `window` words.
OVERRIDE_TRIGGERS = [
    "ignore", "ignoring", "disregard", "forget", "override", "overrule", "bypass", "discard",
]
OVERRIDE_TARGETS = [
    "previous", "prior", "preceding", "earlier", "above", "instruction", "instructions",
    "prompt", "guardrails", "restrictions", "directives",
]
OVERRIDE_WINDOW = 4
EXFILTRATION_TRIGGERS = [
    "send", "sends", "sent", "sending", "email", "emails", "emailed", "upload", "uploads",
    "uploaded", "post", "posts", "posted", "posting", "exfiltrate", "exfiltrated", "transmit",
    "transmitted", "forward", "forwarded", "leak", "leaked", "curl", "wget",
]
EXFILTRATION_TARGETS = [
    "ssh", "rsa", "env", "credentials", "credential", "password", "passwords", "secret",
    "secrets", "token", "tokens", "apikey", "keys", "cookie", "cookies", "aws",
]
EXFILTRATION_WINDOW = 8

# --- argument detectors (names in reporting order) ---------------------------
SSRF = "ssrf"
SENSITIVE_PATH = "sensitive-path"
PATH_TRAVERSAL = "path-traversal"
SHELL_METACHAR = "shell-metachar"
TOO_LARGE = "argument-too-large"
DETECTORS = [SSRF, SENSITIVE_PATH, PATH_TRAVERSAL, SHELL_METACHAR]
REPORTING_ORDER = DETECTORS + [TOO_LARGE]
DETECTOR_TEXT = {
    SSRF: "an address inside the own network or of a cloud's metadata service",
    SENSITIVE_PATH: "a file that usually holds credentials",
    PATH_TRAVERSAL: "a path with steps upwards",
    SHELL_METACHAR: "shell syntax in a command",
    TOO_LARGE: "too many, too long or too deeply nested values",
}

MAX_DEPTH = 64
MAX_VALUES = 1_000_000
MAX_CHARACTERS = 16 * 1024 * 1024
MAX_LABEL = 80
MAX_PLAIN_NAME = 64

# Words of an argument name that say what its value is (a plural "s" is ignored).
COMMAND_WORDS = ["command", "cmd", "script", "shell", "exec", "args", "argv"]
PATH_WORDS = [
    "path", "file", "filename", "filepath", "dir", "directory", "folder", "src", "source",
    "dest", "destination", "target",
]

# --- paths -------------------------------------------------------------------
SEPARATORS = "/\\\u2215\u2044\uff0f\uff3c\u29f5"  # solidus, backslash and look-alikes
DOTS = ".\uff0e\u2024"
CREDENTIAL_FILES = [
    ".npmrc", ".pypirc", ".netrc", "_netrc", ".git-credentials", ".env", ".pgpass",
    "login data", "logins.json", "key3.db", "key4.db", "cookies.sqlite", "signons.sqlite",
]
PRIVATE_KEYS = [
    "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "id_ecdsa_sk", "id_ed25519_sk",
]
SSH_DIRECTORY = ".ssh"
ENV_PREFIX = ".env."
ENV_TEMPLATES = [".example", ".sample", ".template"]
CREDENTIAL_SEQUENCES = [
    ".aws/credentials", ".config/gcloud", ".kube/config", ".docker/config.json", "etc/shadow",
    "etc/gshadow", "etc/sudoers", "etc/sudoers.d", "library/keychains",
    "appdata/roaming/microsoft/credentials", "appdata/local/microsoft/credentials",
]
BROWSER_DIRECTORIES = [
    "chrome", "chromium", "google-chrome", "brave-browser", "bravesoftware", "microsoft edge",
    "edge", "firefox", "mozilla", "opera software", "vivaldi",
]
BROWSER_STORES = ["cookies", "web data"]

# --- read-only mismatch ------------------------------------------------------
# verb -> forms that count in a description; names count base forms only.
WRITE_VERBS = {
    "delete": ["delete", "deletes", "deleted", "deleting"],
    "remove": ["remove", "removes", "removed", "removing"],
    "drop": ["drop", "drops", "dropped", "dropping"],
    "write": ["write", "writes", "wrote", "written", "writing"],
    "update": ["update", "updates", "updated", "updating"],
    "send": ["send", "sends", "sent", "sending"],
    "execute": ["execute", "executes", "executed", "executing"],
    "create": ["create", "creates", "created", "creating"],
    "edit": ["edit", "edits", "edited", "editing"],
    "move": ["move", "moves", "moved", "moving"],
    "rename": ["rename", "renames", "renamed", "renaming"],
    "insert": ["insert", "inserts", "inserted", "inserting"],
    "modify": ["modify", "modifies", "modified", "modifying"],
    "overwrite": ["overwrite", "overwrites", "overwrote", "overwritten", "overwriting"],
    "truncate": ["truncate", "truncates", "truncated", "truncating"],
    "purge": ["purge", "purges", "purged", "purging"],
    "kill": ["kill", "kills", "killed", "killing"],
}
NAME_ONLY_VERBS = {"exec": "execute", "set": "set"}

# --- schema suggestions ------------------------------------------------------
SCHEMA_VALUE_KEYWORDS = ["default", "const", "example"]
SCHEMA_LIST_KEYWORDS = ["examples", "enum"]
SCHEMA_NAMING_KEYWORDS = ["properties", "patternProperties"]
SCHEMA_MAP_KEYWORDS = SCHEMA_NAMING_KEYWORDS + [
    "$defs", "definitions", "dependentSchemas", "dependencies",
]
SCHEMA_ARRAY_KEYWORDS = [
    "anyOf", "oneOf", "allOf", "prefixItems", "items", "additionalItems",
]
SCHEMA_CHILD_KEYWORDS = [
    "items", "additionalItems", "additionalProperties", "unevaluatedItems",
    "unevaluatedProperties", "propertyNames", "not", "if", "then", "else", "contains",
]
MAX_LOCATION = 120

# --- secrets -----------------------------------------------------------------
CREDENTIAL_KEY_WORDS = [
    "TOKEN", "SECRET", "PASSWORD", "PASSWD", "PASS", "KEY", "APIKEY", "AUTH", "AUTHORIZATION",
    "CREDENTIAL", "CREDENTIALS", "PAT", "COOKIE", "PRIVATE",
]

# --- approvals, audit, metrics ----------------------------------------------
DEFAULT_APPROVAL_TIMEOUT_S = 300
APPROVAL_OUTCOMES = ["approved", "declined", "timed_out", "unavailable", "failed"]
APPROVAL_ARGUMENT_LENGTH = 256
APPROVAL_RENDERED_LENGTH = 2048
CLASSIFIER_MAX_CHARS = 32_000
DURATION_BOUNDS_S = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]
OTHER_TOOL = "_OTHER"
TOOL_ERROR = "tool_error"
MISSING_TOOL = "(missing)"
QUALIFIER = "__"

METADATA_RULE = "injection.metadata"
PIN_CHANGED_RULE = "pins.changed"
PIN_NEW_RULE = "pins.new_tool"
SECRETS_RULE = "secrets.arguments"
ARGUMENTS_RULE_PREFIX = "arguments."
UNREADABLE_RULE = "arguments.unreadable"

HIDDEN_CHARACTERS = "\u200b\u2060\u202a-\u202e\u2066-\u2069"
UNPRINTABLE = (
    "\\p{Cc}\u061c\u200b-\u200f\u2028\u2029\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
)
