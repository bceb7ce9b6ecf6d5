"""Fixed values that results depend on: role codes, permissions, routes, phrases and texts."""

# fixed values: roles by id, permission level is the id
ROLES = [
    (0, "SUPER_ADMIN"),
    (1, "TENANT_ADMIN"),
    (2, "KB_ADMIN"),
    (3, "CONTRIBUTOR"),
    (4, "VIEWER"),
]
NO_ROLE = "NONE"
UNKNOWN_LEVEL = 2147483647
SUPER_TENANT = 0

# fixed values: permissions held by every administrator of a tenant, then the narrower roles
PERMISSIONS = [
    "tenant:manage", "user:manage", "role:assign", "kb:create", "kb:config", "kb:delete",
    "kb:permission", "doc:upload", "doc:delete", "doc:reprocess", "doc:view", "chat:query",
]
ROLE_PERMISSIONS = {
    "SUPER_ADMIN": PERMISSIONS,
    "TENANT_ADMIN": PERMISSIONS,
    "KB_ADMIN": ["kb:create", "kb:config", "kb:permission", "doc:upload", "doc:delete",
                 "doc:reprocess", "doc:view", "chat:query"],
    "CONTRIBUTOR": ["doc:upload", "doc:reprocess", "doc:view", "chat:query"],
    "VIEWER": ["doc:view", "chat:query"],
}

# fixed values: roles that may perform an action on a knowledge base
ACTION_ROLES = {
    "view": ["SUPER_ADMIN", "TENANT_ADMIN", "KB_ADMIN", "CONTRIBUTOR", "VIEWER"],
    "upload": ["SUPER_ADMIN", "TENANT_ADMIN", "KB_ADMIN", "CONTRIBUTOR"],
    "admin": ["SUPER_ADMIN", "TENANT_ADMIN", "KB_ADMIN"],
    "delete": ["SUPER_ADMIN", "TENANT_ADMIN", "KB_ADMIN"],
}

# fixed values: file extension -> parser kind
PARSER_BY_EXTENSION = {
    "pdf": "layout",
    "docx": "mixed", "doc": "mixed", "pptx": "mixed", "ppt": "mixed",
    "xlsx": "table", "xls": "table",
    "txt": "text", "md": "text", "markdown": "text", "html": "text", "htm": "text",
    "jpg": "ocr", "jpeg": "ocr", "png": "ocr", "bmp": "ocr",
}
LAYOUT_OVERRIDE = "mineru"

# fixed values: document processing states in order; any state may also go to FAILED
STATUS_ORDER = ["PENDING", "PARSING", "PARSED", "CHUNKING", "CHUNKED", "VECTORIZING", "COMPLETED"]
FAILED = "FAILED"

# fixed values: sentence ends for cutting oversized text
SENTENCE_ENDS = "。！？；.!?;\n"

# fixed values: numbered-heading forms
TITLE_FORMS = (
    "第[一二三四五六七八九十百千万0-9]+[章条节部分篇]"
    "|[一二三四五六七八九十]+、"
    "|（[一二三四五六七八九十]+）"
    "|\\([一二三四五六七八九十]+\\)"
    "|[0-9]+[.、]"
    "|[一二三四五六七八九十]+[.]"
)
TITLE_MAX = 50

# fixed values: characters that carry no meaning in recognised text
OCR_NOISE = "[\\s\\{\\}\\[\\]\\(\\)<>|_\\-=+*·•\\\\,;:.\"'`~^/、，。：；！？…—－]"
OCR_MIN_CHARS = 5

# fixed values: phrases that mark an unsafe input
INJECTION_PHRASES = [
    "ignore previous instructions",
    "disregard the above",
    "forget your instructions",
    "忽略上述指令",
    "无视以上内容",
    "你现在的角色是",
    "system prompt:",
    "reveal your prompt",
]

# fixed values: texts placed into prompts and answers
CONTEXT_HEAD = "参考资料：\n"
QUESTION_HEAD = "\n\n用户问题："
NO_ANSWER = "根据现有资料无法回答该问题。"
FALLBACK_EMPTY = "根据现有资料无法回答。"
FALLBACK_HEAD = "根据现有资料无法生成完整回答，以下为相关参考片段：\n\n"
BLANK_HEADER = "列"
SHEET_BREAK = "\n\n---\n\n"

# fixed values: default sizes
TEXT_DELIMITER, TEXT_MAX, TEXT_OVERLAP = "\n", 1024, 50
PARENT_SEP, PARENT_MAX, CHILD_SEP, CHILD_MAX = "\n\n\n", 2048, "\n\n", 1024
PARENT_MODE = "paragraph"
TEXT_MODEL, HIERARCHICAL_MODEL = "text_model", "hierarchical_model"
SEARCH_K, CHAT_K, RRF_K = 5, 10, 60
BM25_K1, BM25_B = 1.2, 0.75
CONTEXT_BUDGET, CONTEXT_RESERVE = 6000, 100
HISTORY_ROUNDS, HISTORY_TOKENS, REWRITE_ROUNDS = 10, 3000, 3
SESSION_TTL_SECONDS = 3600
TEMP_DOC_MAX, TEMP_K = 5, 5
TITLE_CHARS = 50
LOCK_FAILURES, LOCK_MINUTES = 5, 30
KEEP_VERSIONS = 10
TABLE_ROW_LIMIT = 20

#: largest uploaded file in bytes
MAX_FILE_BYTES = 100 * 1024 * 1024

#: candidates that a reranking model takes at once
RERANK_BATCH = 20
