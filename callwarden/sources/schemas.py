"""Explicit schemas of every source; nothing is inferred."""

CALLS = (
    "call_id string, ts timestamp, session_id string, tool string, arguments string, "
    "principal string, groups array<string>"
)
ANNOTATIONS = (
    "struct<title:string,readOnlyHint:boolean,destructiveHint:boolean,idempotentHint:boolean,"
    "openWorldHint:boolean>"
)
TOOL = (
    "struct<name:string,title:string,description:string,inputSchema:string,outputSchema:string,"
    f"annotations:{ANNOTATIONS}>"
)
CAPTURE = f"server string, captured_at timestamp, tools array<{TOOL}>"
CATALOG = (
    "server string, captured_at timestamp, name string, title string, description string, "
    f"input_schema string, output_schema string, annotations {ANNOTATIONS}"
)
RESULT = (
    "call_id string, content array<struct<type:string,text:string,"
    "resource:struct<uri:string,mimeType:string,text:string>>>, structuredContent string, isError boolean"
)
SERVERS = (
    "server string, transport string, command string, args array<string>, url string, "
    "optional boolean, reachable boolean"
)
PINS = (
    "server string, identity string, identity_hint string, pinned_at timestamp, tool string, "
    "hash string, definition string"
)
ANSWERS = "request_id string, ts timestamp, outcome string"
VERDICTS = "call_id string, outcome string, truncated boolean, error string"
CASES = (
    "case_no int, name string, call string, args string, principal string, groups array<string>, "
    "expect string, rule string, argument_hits array<string>, unknown boolean"
)

# `decision_source` is ours: the metrics need it and the log alone would not tell.
AUDIT_COLUMNS = {
    "ts": "timestamp",
    "event": "string",
    "tool": "string",
    "server": "string",
    "downstream_tool": "string",
    "principal": "string",
    "arguments": "string",
    "decision": "string",
    "decision_source": "string",
    "rule": "string",
    "decision_reason": "string",
    "approval": "string",
    "approval_channel": "string",
    "scanner_hits": "array<string>",
    "scanner_action": "string",
    "scanner_structured_content_withheld": "boolean",
    "classifier": "string",
    "classifier_truncated": "boolean",
    "classifier_error": "string",
    "argument_secrets": "array<string>",
    "argument_secrets_action": "string",
    "argument_hits": "array<string>",
    "argument_hits_action": "string",
    "result_secrets": "array<string>",
    "result_secrets_action": "string",
    "transport": "string",
    "tool_count": "int",
    "identity": "string",
    "pin_change": "string",
    "duration_ms": "double",
    "is_error": "boolean",
    "error": "string",
}
AUDIT = ", ".join(f"{name} {kind}" for name, kind in AUDIT_COLUMNS.items())
