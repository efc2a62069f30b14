"""Word lists, patterns, constants and formats.

Every value in this module is part of the results contract (which text counts as an
amount, which words are ignored, how deep a leg goes) and must stay exactly as it is.
Logic lives elsewhere; this file holds only data.
"""

# --- FIXED VALUES: field rules, applied in this order ------------------------------------
AMOUNT_PATTERN = r"(?:₹|\$|€|£|Rs\.?|INR|USD|EUR)\s?\d[\d,]*(?:\.\d{1,2})?"
DATE_PATTERN = (
    r"\b\d{4}-\d{2}-\d{2}\b"
    r"|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
    r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b"
)
FIELD_RULES = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("url", r"https?://[^\s)>\]]+"),
    ("amount", AMOUNT_PATTERN),
    ("date", DATE_PATTERN),
    ("phone", r"(?<!\d)(?:\+\d{1,3}[\s-]?)?(?:\d[\s-]?){9,12}\d(?!\d)"),
]
LINE_ITEM_PATTERN = r"([A-Za-z][A-Za-z0-9 \-]*?)\s+[x×](\d+)\s+(" + AMOUNT_PATTERN + ")"
PAIR_PATTERN = r"^[ \t]*([A-Za-z][\w \-/]{1,39})[ \t]*:(?![:=])[ \t]*(.+?)[ \t]*$"
PAIR_NOISE_PATTERN = r"[|<>{}\[\]`]|-->|-\|>|-\.->|==>|->|::|:=|&&"
FENCE_PATTERN = r"```.*?```"
DIAGRAM_LINE_PATTERN = (
    r"^\s*(graph|flowchart|sequenceDiagram|classDiagram|erDiagram|stateDiagram|gantt|"
    r"subgraph|style|classDef|class|linkStyle|participant|actor|note (?:over|left|right))\b"
)
ARROW_LINE_PATTERN = r"-->|-\.->|==>|-\|>|\|>|--\||~~~|→|←|⟶"
URL_SCHEMES = ["http", "https", "ftp", "mailto", "tel"]
NUMERIC_CELL_PATTERN = r"^[+-]?[\d,]*\.?\d+%?$"
PAIR_VALUE_MAX = 120
PAIR_READABLE_SHARE = 0.4

# --- FIXED VALUES: chunking ---------------------------------------------------------------
MAX_TOKENS = 450
OVERLAP_WORDS = 40

# --- FIXED VALUES: search -----------------------------------------------------------------
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "am", "im", "i",
    "who", "what", "when", "where", "why", "how", "which", "whom",
    "of", "to", "in", "on", "at", "for", "and", "or", "but", "if", "it", "its",
    "this", "that", "these", "those", "as", "by", "with", "from", "do", "does",
    "did", "can", "could", "will", "would", "my", "me", "you", "your", "we",
]
# the client-side highlighter ignores a slightly shorter list
HIGHLIGHT_STOPWORDS = (
    "a an the is are was were be been am im i who what when where why how which of to in on "
    "at for and or but if it its this that as by with from do does did can could will would "
    "my me you your we"
).split()
QUERY_TOKEN_PATTERN = r'"[^"]*"|\S+'
QUERY_OPERATORS = ["AND", "OR", "NOT"]
QUERY_NEAR = "NEAR"
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
LEG_DEPTH = 100
RRF_K = 60
LEG_WEIGHTS = {"keyword": 1.0, "semantic": 1.0, "title": 2.0}
SNIPPET_WIDTH = 220
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
DEFAULT_PAGE = 20

# --- FIXED VALUES: question routing -------------------------------------------------------
AGGREGATE_CUES = [
    "how many", "how much total", "count", "number of", "list all", "list the",
    "list every", "all the", "every ", "distinct", "unique", "total number",
    "which companies", "which vendors", "how many invoices", "across all", "sum of",
    "average", "breakdown", "group by", "each ",
    "total amount", "total spent", "total cost", "total value", "total price",
    "grand total", "how much did", "how much have", "how much was", "total for",
    "total on", "spent on",
    "what all", "bought", "did i buy", "purchase", "product", "line item", "items",
]
PAIR_CUES = [
    "compan", "vendor", "supplier", "client", "customer", "owner", "buyer",
    "seller", "who ", "whom", "name", "entit", "organi", "party", "parties",
    "distinct", "unique", "list all", "list the", "list every",
]
FIELD_INTENT_CUES = {
    "item": ["item", "items", "product", "bought", "buy", "purchase", "line item", "goods"],
    "amount": ["amount", "total", "price", "cost", "sum", "paid", "payable", "due",
               "how much", "rupee", "dollar", "rs", "inr", "usd", "₹", "$"],
    "date": ["date", "when", "due date", "deadline", "day", "dated"],
    "email": ["email", "e-mail", "mail id", "mail-id"],
    "phone": ["phone", "mobile", "contact number", "call", "telephone"],
    "url": ["url", "link", "website", "site", "web address"],
}
KIND_SPECIFICITY = ["item", "pair", "email", "url", "phone", "date", "amount"]
KIND_PRIORITY = ["amount", "date", "email", "phone", "url", "item", "pair"]
UNKNOWN_KIND_RANK = 9
DIRECT_ANSWER_LIMIT = 12
SUMMARY_MAX_CHARS = 11000
SUMMARY_FIELDS_PER_DOC = 15
SUMMARY_HEAD = "LIBRARY — {} documents (your complete library). Format: title [type] :: field=value; …"
SUMMARY_TAIL = " more document(s) omitted to fit the size limit)"
OVERVIEW_FIELDS = 10
PREVIEW_CHARS = 12000
PREVIEW_TAIL = "\n\n… (truncated — full text is indexed)"

# --- FIXED VALUES: whole-table aggregation ------------------------------------------------
AVG_CUES = ["average", "avg", "mean"]
SUM_CUES = ["total", "sum", "combined", "altogether", "overall"]
COUNT_CUES = ["how many", "number of", "count"]
TABLE_STOPWORDS = [
    "total", "sum", "combined", "altogether", "overall", "average", "avg", "mean", "count",
    "many", "number", "how", "of", "all", "the", "is", "are", "was", "were", "what", "which",
    "in", "on", "do", "did", "i", "have", "my", "a", "an", "there", "across", "and", "for",
    "to", "me", "with",
]
MEASURE_WORDS = [
    "total", "amount", "value", "price", "salary", "cost", "revenue",
    "spend", "bonus", "qty", "quantity", "sum", "fee", "balance", "score",
]
NUMERIC_SHARE = 0.6
MAX_FACTS = 3

FACTS_HEAD = (
    "TABLE FACTS (computed in code over the COMPLETE table — authoritative, use these "
    "exact numbers verbatim; never recompute from the excerpts):\n"
)
ROWS_IN = 'number of rows in "'

# --- FIXED VALUES: answers ----------------------------------------------------------------
MONEY_PATTERN = r"(?:rs\.?|inr|₹|\$)\s*(\d[\d,]*(?:\.\d+)?)|(\d[\d,]*\.\d{2})(?!\d)"
EXCERPT_CHARS = 1200

# --- FIXED VALUES: admission --------------------------------------------------------------
MAX_UPLOAD_MB = 25
TOO_LARGE = "file exceeds {}MB limit"
UNSUPPORTED = "unsupported file type: "
DUPLICATE = "duplicate"
EMPTY_FILE = "file is empty"
NO_TEXT = "no extractable text"
NO_JSON_DATA = "no data found in JSON"
NO_HEADER = "no header row detected — columns auto-named Column 1..N"
INVALID_JSON = "invalid JSON: "
SUPPORTED_TYPES = ["txt", "md", "csv", "json", "html", "htm"]

# --- FIXED VALUES: white space and line ends, as character classes ------------------------
# The set that counts as white space / as a line break for the text rules, written so that
# both Java and RE2 regular expressions accept it.
SPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPACE_CHARACTERS = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
LINE_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NON_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"
