"""Word lists, weights, patterns and formats that decide results.

Everything here is data. Changing a value changes results, so nothing in this
module may be tuned for speed.
"""

# --- chunking ---------------------------------------------------------------
MAX_CHUNK_WORDS = 1000
OVERLAP_WORDS = 120
MIN_CHUNK_WORDS = 4
CHUNK_TYPES = [
    "page_summary",
    "section",
    "paragraph_group",
    "faq",
    "table",
    "image_context",
    "social_link",
    "structured_data",
]

# --- social platforms -------------------------------------------------------
SOCIAL_DOMAINS = {
    "instagram": ["instagram.com"],
    "facebook": ["facebook.com", "fb.com"],
    "youtube": ["youtube.com", "youtu.be"],
    "tiktok": ["tiktok.com"],
    "twitter": ["twitter.com", "x.com"],
    "linkedin": ["linkedin.com"],
    "pinterest": ["pinterest.com"],
    "whatsapp": ["wa.me", "whatsapp.com"],
}
SOCIAL_LABELS = {
    "instagram": "Instagram",
    "facebook": "Facebook",
    "youtube": "YouTube",
    "tiktok": "TikTok",
    "twitter": "Twitter/X",
    "linkedin": "LinkedIn",
    "pinterest": "Pinterest",
    "whatsapp": "WhatsApp",
}
TWITTER_LINK_TEXTS = ["x", "twitter/x", "x twitter"]
EMBEDDED_URL_PATTERN = r"(?i)https?://[^\s\"'<>)}\]]+"

# --- URLs -------------------------------------------------------------------
TRACKING_QUERY_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "msclkid"]
TRACKING_QUERY_PREFIX = "utm_"
HIGH_PRIORITY_KEYWORDS = [
    "about", "contact", "docs", "documentation", "faq", "features", "pricing",
    "products", "services", "solutions",
]
MEDIUM_PRIORITY_KEYWORDS = [
    "blog", "careers", "case-studies", "customers", "help", "news", "resources",
    "team",
]
LOW_PRIORITY_KEYWORDS = ["archive", "category", "legal", "privacy", "tag", "terms"]
SEARCH_QUERY_KEYS = ["keyword", "q", "query", "s", "search", "term"]
SEARCH_PATH_SEGMENTS = [
    "find", "lookup", "results", "search", "search-results", "search_results",
]
SKIP_PATH_KEYWORDS = [
    "account", "cart", "checkout", "login", "password", "register", "signin",
    "signup",
]
UTILITY_SEGMENTS = [
    "about", "account", "admin", "archive", "archives", "cart", "category",
    "checkout", "contact", "contact-us", "help", "legal", "login", "privacy",
    "register", "signin", "signup", "special", "tag", "tags", "terms",
]
UTILITY_TOKEN_GROUPS = [
    ["authority", "control"], ["pronunciation"], ["language"], ["languages"], ["ipa"],
]
UTILITY_PAGE_TYPES = ["about", "contact", "legal"]
WIKI_NAMESPACES = [
    "category", "file", "help", "portal", "special", "talk", "template", "wikipedia",
]
URL_TOKEN_STOPWORDS = [
    "a", "an", "and", "article", "articles", "blog", "com", "doc", "docs",
    "documentation", "en", "home", "html", "htm", "index", "main", "of", "org",
    "page", "pages", "the", "to", "wiki", "www",
]
DOWNLOAD_EXTENSIONS = [
    ".avi", ".doc", ".docx", ".gif", ".jpeg", ".jpg", ".mov", ".mp3", ".mp4",
    ".pdf", ".png", ".ppt", ".pptx", ".svg", ".webp", ".xls", ".xlsx", ".zip",
]
PAGE_TYPE_TOKENS = [
    ("about", ["about", "about-us", "who-we-are"]),
    ("services", ["service", "services"]),
    ("products", ["product", "products"]),
    ("pricing", ["pricing", "plans"]),
    ("docs", ["doc", "docs", "documentation"]),
    ("faq", ["faq", "faqs"]),
    ("contact", ["contact"]),
    ("blog", ["blog"]),
    ("team", ["team"]),
    ("careers", ["careers", "jobs"]),
    ("legal", ["privacy", "terms", "legal"]),
]
HIGH_VALUE_PAGE_TYPES = [
    "about", "services", "products", "pricing", "faq", "contact", "docs",
]
MEDIUM_VALUE_PAGE_TYPES = ["blog", "team", "careers"]
CRAWL_HOMEPAGE = "homepage_site_crawl"
CRAWL_SPECIFIC = "specific_page_crawl"
COMMON_SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]
MAX_SITEMAP_FILES = 5
MAX_SITEMAP_URLS = 100
MAX_PAGES_PER_SITE = 10
MAX_SPECIFIC_PAGES = 5

# --- HTML extraction --------------------------------------------------------
NOISE_PATTERNS = [
    "ad-", "ads", "advertisement", "banner", "cookie", "modal", "newsletter",
    "overlay", "popup", "promo", "subscribe",
]
NOISE_TAGS = ["script", "style", "noscript", "iframe", "svg"]
KEEP_WHEN_EMPTY_TAGS = ["img", "table", "thead", "tbody", "tr", "th", "td"]
SKIP_LINK_SCHEMES = ["javascript:", "mailto:", "tel:"]
SKIP_IMAGE_SCHEMES = ["data:", "blob:", "javascript:", "mailto:", "tel:"]
IMAGE_SOURCE_ATTRS = [
    "src", "data-src", "data-lazy-src", "data-original", "data-srcset", "srcset",
]
PICTURE_SOURCE_ATTRS = ["srcset", "data-srcset", "src", "data-src"]
PLACEHOLDER_IMAGE_PATTERNS = [
    "blank", "pixel", "placeholder", "spacer", "transparent", "tracking",
]
ICON_IMAGE_PATTERNS = [
    "avatar-icon", "facebook", "favicon", "icon", "instagram", "linkedin",
    "social", "sprite", "twitter", "youtube",
]
IMAGE_SOCIAL_NAMES = ["facebook", "instagram", "linkedin", "twitter", "youtube"]
IMAGE_TYPE_WORDS = [
    ("logo", ["logo"]),
    ("icon", ICON_IMAGE_PATTERNS),
    ("decorative", ["background", "decorative"]),
    ("hero", ["hero", "banner", "cover"]),
    ("product", ["product", "catalog", "sku", "shop"]),
    ("team", ["team", "staff", "founder", "leader", "people"]),
    ("diagram", ["diagram", "chart", "graph", "flow", "infographic"]),
    ("screenshot", ["screenshot", "screen shot", "dashboard", "interface"]),
]
FAQ_QUESTION_PATTERN = (
    r"(?i)\?$|^(q:|question:)|\b(what|why|how|when|where|who|can|do|does|is|are)\b"
)
MAX_CONTENT_CHARS = 12000
MAX_NEARBY_CHARS = 300
SECTION_STOP_CHARS = 2000
MAX_SECTIONS = 20
FAQ_STOP_CHARS = 600
MAX_FAQ_ANSWER_CHARS = 1000
SPA_ROOT_IDS = ["root", "app", "__next", "__nuxt"]
HYDRATION_MARKERS = [
    "__NEXT_DATA__", "__NUXT__", "data-reactroot", "hydrateRoot", "createRoot(",
    "ng-version", "data-v-app",
]

# --- query intents ----------------------------------------------------------
INTENTS = [
    "social_link", "contact", "location", "policy", "image", "product", "faq",
    "general",
]
QUERY_STOPWORDS = [
    "a", "an", "and", "are", "at", "by", "for", "from", "how", "i", "in", "is",
    "me", "of", "on", "or", "the", "them", "this", "to", "what", "with",
]
INTENT_KEYWORDS = {
    "contact": [
        "contact", "phone", "number", "call", "whatsapp", "email", "customer",
        "service", "support", "helpline",
    ],
    "location": [
        "store", "location", "locations", "address", "branch", "branches",
        "where", "lahore", "islamabad", "karachi", "mall",
    ],
    "policy": [
        "privacy", "terms", "policy", "refund", "return", "exchange", "shipping",
        "delivery",
    ],
    "image": ["image", "picture", "photo", "look", "design", "style"],
    "product": [
        "price", "product", "size", "color", "material", "pants", "shirt",
        "shoes", "collection",
    ],
    "faq": ["faq", "question", "help"],
}
INTENT_PHRASES = {
    "contact": ["customer service"],
    "location": ["store location"],
    "policy": ["privacy policy", "terms of service"],
}
SOCIAL_PLATFORM_WORDS = [
    "instagram", "facebook", "youtube", "tiktok", "twitter", "linkedin",
    "pinterest",
]
SOCIAL_LINK_WORDS = [
    "social", "media", "link", "links", "profile", "handle", "page", "account",
    "official",
]
WHATSAPP_LINK_WORDS = ["link", "links", "profile", "handle", "account"]
SOCIAL_PHRASES = ["social media", "official account", "x.com", "twitter.com"]

# --- rerank scoring ---------------------------------------------------------
PHONE_PATTERN = r"(\+92|0092|03\d{2}[\s-]?\d{6,7}|\b\d{4}[\s-]?\d{7}\b)"
EMAIL_PATTERN = r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
SCORE_WEIGHTS = {
    "vector_score": 0.35,
    "keyword_overlap": 1.20,
    "intent_match": 1.65,
    "chunk_type_weight": 0.85,
    "source_relevance": 0.75,
    "content_quality": 0.45,
}
# (weight per phrase found in the searchable text, phrases)
MATCH_PHRASES = {
    "contact": (0.18, [
        "whatsapp", "contact us", "customer service", "support", "helpline", "call us",
    ]),
    "location": (0.16, [
        "store location", "address", "branch", "branches", "lahore", "islamabad",
        "karachi", "mall", "markaz", "block", "floor", "shop", "maps",
    ]),
    "policy": (0.2, [
        "refund", "return", "exchange", "privacy policy", "terms of service",
        "shipping", "delivery",
    ]),
    "image": (0.12, ["image", "picture", "photo", "look", "design", "style", "color"]),
    "product": (0.14, ["price", "size", "color", "material", "collection", "product"]),
}
# (weight once, words looked for in title + URL)
MATCH_SOURCE_WORDS = {
    "social_link": (0.12, ["social", "instagram", "facebook", "youtube", "tiktok"]),
    "contact": (0.18, ["contact", "support", "customer-service"]),
    "location": (0.16, ["store", "location", "branch", "contact"]),
    "policy": (0.16, ["privacy", "terms", "refund", "return", "shipping"]),
    "product": (0.2, ["/products/", "product"]),
}
FAQ_MATCH_WORDS = ["faq", "question", "answer", "help", "support"]
# per intent: (weight once, words looked for in title + URL)
SOURCE_RELEVANCE = {
    "social_link": [
        (0.45, ["social", "instagram", "facebook", "youtube", "tiktok"]),
        (0.15, ["contact", "about", "home"]),
    ],
    "contact": [
        (0.55, ["contact"]),
        (0.35, ["support", "customer-service", "customer_service", "whatsapp"]),
        (0.2, ["/pages/contact"]),
    ],
    "location": [
        (0.55, ["store", "location", "branch", "contact"]),
        (0.25, ["lahore", "islamabad", "karachi"]),
    ],
    "policy": [
        (0.65, ["privacy", "terms", "refund", "return", "shipping", "delivery"]),
    ],
    "image": [(0.35, ["image", "product", "collection"])],
    "product": [(0.5, ["product", "collection", "shop"])],
    "faq": [(0.6, ["faq", "help", "support"])],
}
# chunk type -> ({intent: weight}, weight for the other intents)
TYPE_WEIGHTS = {
    "social_link": ({"social_link": 1.0}, 0.5),
    "section": ({"social_link": 0.72}, 0.95),
    "paragraph_group": ({"social_link": 0.62}, 0.9),
    "faq": ({"contact": 0.9, "policy": 0.9, "faq": 0.9, "general": 0.9}, 0.75),
    "table": ({}, 0.7),
    "structured_data": (
        {"social_link": 0.82, "contact": 0.45, "location": 0.45, "policy": 0.45}, 0.35,
    ),
    "image_context": ({"image": 0.9, "product": 0.45}, 0.08),
    "page_summary": ({}, 0.18),
}
OTHER_TYPE_WEIGHT = 0.45
TEXT_KEY_CHARS = 320

# --- retrieval --------------------------------------------------------------
DEFAULT_TOP_K = 5
VECTOR_MULTIPLIER = 4
MIN_VECTOR_CANDIDATES = 20
LEXICAL_LIMIT = 2000

# --- prompt and quality -----------------------------------------------------
MAX_CONTEXT_CHUNKS = 8
MAX_CONTEXT_CHARS = 1400
PREVIEW_CHARS = 240
HISTORY_MESSAGES = 6
MAX_SOURCES = 5
MIN_USEFUL_CHARS = 25
MSG_NO_CHUNKS = "No relevant indexed chunks were found for this website."
MSG_NOT_READABLE = "Retrieved chunks did not contain enough readable website text."
MSG_SOME_WEAK = "Some retrieved chunks had weak or empty text and were ignored by the prompt."
MSG_NO_URL = "Some retrieved chunks are missing source URLs."
MSG_NO_TITLE = "Some retrieved chunks are missing page titles."
MSG_ONE_SOURCE = (
    "Retrieved context is concentrated in one weak source, so the answer may be incomplete."
)
MSG_NO_SOURCES = "No sources were formatted for this answer."
MSG_DUPLICATE_SOURCE = "Duplicate source records were returned."
INSUFFICIENT_ANSWER = (
    "The website does not provide enough information from indexed context to answer that question."
)

# --- knowledge context ------------------------------------------------------
KEY_PAGE_WORDS = [
    "about", "contact", "services", "products", "team", "pricing", "faq", "books",
    "publications", "cv", "resume",
]
MAX_SEARCHES = 5
SEARCH_RESULT_CHARS = 1000

# --- answer evaluation ------------------------------------------------------
ANSWER_URL_PATTERN = r"(?i)https?://[^\s<>)\"']+"
MARKDOWN_LINK_PATTERN = r"(?i)\[[^\]]+\]\(https?://[^)\s]+\)"
ANSWER_PHONE_PATTERN = r"(\+?\d[\d\s().-]{7,}\d)"
ANSWER_EMAIL_PATTERN = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
ANSWER_TIME_PATTERN = (
    r"(?i)\b(\d{1,2}(:\d{2})?\s?(am|pm|a\.m\.|p\.m\.)|\d{1,2}\s?-\s?\d{1,2})\b"
)
NOT_ENOUGH_PATTERN = (
    r"(?i)(not enough information|does not provide enough information|"
    r"do not have enough information|doesn't provide enough information|"
    r"not provided|not available|cannot determine)"
)
BULLET_PATTERN = r"(?m)^\s*[-*]\s+\S+"
NUMBERED_PATTERN = r"(?m)^\s*\d+\.\s+\S+"
CITY_NAMES = [
    "Lahore", "Karachi", "Islamabad", "Rawalpindi", "Faisalabad", "Multan",
    "Peshawar", "Quetta",
]
SUMMARY_FLAGS = [
    "missing_sources", "missing_url", "missing_markdown_link", "missing_phone",
    "missing_email", "missing_hours", "missing_bullets", "missing_city_grouping",
    "possible_hallucination", "non_rag_mode", "very_short_answer",
    "raw_unformatted_long_answer",
]
RESULT_CSV_FIELDS = [
    "question_id", "category", "intent", "question", "expected_behavior",
    "answer_format", "expected_entities", "answer", "mode", "source_count",
    "source_titles", "source_urls", "source_types", "warnings", "flags",
    "has_clickable_markdown_link", "has_raw_url", "has_bullets",
    "has_numbered_list", "detected_phone", "detected_email", "detected_url",
    "detected_cities", "latency_ms", "manual_score", "manual_notes", "issue_type",
]

# Lines of the text contexts of a site
CONTEXT_SCRAPED_HEADER = "=== WEBSITE CONTENT (Primary Source) ==="
CONTEXT_SITE_HEADER = "=== WEBSITE INFORMATION ==="
CONTEXT_PRIMARY_HEADER = "=== PRIMARY SOURCE (Website Content) ==="
CONTEXT_PRIMARY_NOTE = "[This is the most reliable information - directly from the website]"
CONTEXT_HOMEPAGE_HEADER = "## HOMEPAGE (Main Information)"
CONTEXT_BLOG_HEADER = "\n## BLOG/ARTICLES (Recent posts)"
CONTEXT_SECONDARY_HEADER = (
    "\n=== SECONDARY SOURCE (Web Search Supplement) ===\n"
    "[Use this only if primary source doesn't have the answer]\n\n"
)
CONTEXT_RULE = "\n---\n"
