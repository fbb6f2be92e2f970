"""Closed vocabularies, word lists, patterns and limits. All values here are fixed."""

# Vocabularies of the data model.
CLAIM_KINDS = ("checkable", "descriptive", "attributed_statement", "inference", "opinion")
MATERIALITIES = ("ordinary", "material")
EXTRACTION_STATUSES = ("extracted", "rejected")
EVIDENCE_RELATIONS = ("supports", "contradicts", "context")
EVIDENCE_STATUSES = ("pending", "retrieved", "retrieval_failed", "insufficient_scope")
SOURCE_KINDS = ("direct", "search", "firecrawl", "related_article")
FINDING_TYPES = ("factual_contradiction", "material_cross_media_difference", "unsupported_inference")
FINDING_STATUSES = ("pending", "resolved", "dismissed")
TOPIC_CONFIDENCES = ("high", "possible", "low")

# Words shown for findings and for the state of their evidence.
FINDING_LABELS = {"factual_contradiction": "Factual contradiction", "material_cross_media_difference": "Material cross-media difference", "unsupported_inference": "Unsupported inference"}
STATUS_LABELS = {"pending": "Pending check", "retrieval_failed": "Retrieval failed", "insufficient_scope": "Insufficient scope", "retrieved": "Evidence retrieved"}

# Word lists of the topic comparison.
STOPWORDS = ("a", "an", "and", "after", "at", "by", "for", "from", "in", "of", "on", "or", "the", "that", "this", "to", "with", "reported", "reports", "said", "says")
DATE_UNITS = (
    "am", "pm", "day", "days", "hour", "hours", "minute", "minutes", "second", "seconds", "week", "weeks", "month", "months", "year", "years",
    "年", "月", "日", "時", "點", "分", "分鐘", "秒", "週", "星期",
)
ANTONYMS = (("approved", "rejected"), ("opened", "closed"), ("confirmed", "denied"), ("arrested", "released"), ("批准", "否決"), ("開放", "關閉"), ("確認", "否認"), ("逮捕", "釋放"))
SENTENCE_MARKS = ".!?。！？"

# Patterns. (?U) gives Java the Unicode classes that the semantics need.
TOKEN = r"(?U)[A-Za-z][A-Za-z0-9'-]{2,}|[一-鿿]{2,}|\d[\d,]*"
ENTITY = r"(?U)\b[A-Z][a-z]{2,}\b|[一-鿿]{1,7}(?:部|局|會|院|署|市|縣|國|公司|大學|銀行|醫院)"
NUMBER = r"(?U)(?<![\w,])(\d[\d,]*)(?:\s*)([%A-Za-z]+|[一-鿿]{1,4})?"
APPROXIMATE = r"(?iU)(?:about|around|approximately|roughly|nearly|over|under|約|近|逾|超過)\s*\z"
SENSITIVE = r"(?:authorization|cookie|token|secret|password|session|api[-_]key)"
SECRET_VALUE = rf"(?:{SENSITIVE}|(?:access|refresh|client)[_-]?(?:token|secret)|passwd|pwd|session(?:[_-]?id)?)"
CREDENTIAL = r"(?iU)(?:https?://[^\s/@]+:[^\s/@]+@|\b(?:api[-_]?key|(?:access|refresh|client)[-_]?(?:token|secret)|token|secret|password|passwd|pwd|cookie|authorization)\s*(?:=|:))"
SENSITIVE_METADATA = r"(?i)(?:bearer\s+\S+|[\"']?(?:authorization|cookie|token|secret|password|session|api[-_]key|access[_-]?token)[\"']?\s*[:=])"
CHARSET = r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)"
PROVIDER_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"

# Limits.
WINDOW_SECONDS = 72 * 3600
MAX_SUMMARY, MAX_QUERY, MAX_CLAIM, MAX_EXCERPT, MAX_ERROR, MAX_TITLE = 2000, 500, 2000, 2000, 500, 500
MAX_DIFFERENCE, MAX_URL, MAX_CANDIDATES, MAX_BYTES, MAX_HITS = 500, 200, 500, 1_000_000, 10
CONTEXT_POOL, PENDING_LIMIT = 100, 20
MAX_TIMEOUT, MAX_ANALYSIS, MAX_PAGE_TEXT = 20, 20_000, 200_000
