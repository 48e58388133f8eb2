"""Fixed values. They define the results and are stated here as plain text, in natural order."""

RULESET_VERSION = "2026-09-1"

# --- fixed values: category weights, sum 100 ---
CATEGORY_WEIGHTS = {
    "content": 24,
    "indexability": 22,
    "structure": 16,
    "performance": 16,
    "social": 8,
    "mobile": 8,
    "media": 6,
}

# --- fixed values: markup outside the visible text ---
BOILERPLATE_TAGS = (
    "script", "style", "noscript", "template", "svg", "nav",
    "footer", "header", "aside", "form", "iframe",
)

# --- fixed values: HTML void elements (HTML living standard plus the obsolete ones) ---
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
    "command", "frame", "image", "isindex", "nextid", "spacer",
)

# --- fixed values: stop words ---
STOP_WORDS = tuple(
    """
    the is in at of a an and or but not to for on with by as it its be are was were been being
    have has had do does did will would could should may might can shall this that these those
    i me my we our you your he she him her they them their what which who whom when where how
    all each every both few more most other some such no nor only own same so than too very
    just because about into through during before after above below between from up down out
    off over under again further then once here there while if also now
    """.split()
)

# --- fixed values: commercial modifiers and question words of keyword difficulty ---
COMMERCIAL_MODIFIERS = tuple(
    """
    buy price pricing cost cheap cheapest best top review reviews discount deal deals sale near
    vs versus alternative alternatives comparison compare trial free download software tool
    tools service services agency consultant company hire
    """.split()
)
QUESTION_WORDS = ("how", "what", "why", "when", "where", "who", "which")

# --- fixed values: properties required per structured-data type ---
SCHEMA_REQUIREMENTS = {
    "Article": ("headline", "image", "datePublished", "author"),
    "NewsArticle": ("headline", "image", "datePublished", "author"),
    "BlogPosting": ("headline", "image", "datePublished", "author"),
    "Product": ("name", "image", "offers"),
    "BreadcrumbList": ("itemListElement",),
    "Organization": ("name", "url"),
    "LocalBusiness": ("name", "address"),
    "WebSite": ("name", "url"),
    "WebPage": ("name",),
    "FAQPage": ("mainEntity",),
    "Event": ("name", "startDate", "location"),
    "Recipe": ("name", "image", "recipeIngredient", "recipeInstructions"),
    "VideoObject": ("name", "description", "thumbnailUrl", "uploadDate"),
}

# --- fixed values: URL admission ---
DEFAULT_PORTS = {"http": 80, "https": 443}
ALLOWED_PORTS = (80, 443, 3000, 4000, 5000, 8000, 8080, 8443, 9000)
BLOCKED_HOSTNAMES = (
    "localhost", "localhost.localdomain", "ip6-localhost", "metadata", "instance-data",
    "metadata.google.internal", "metadata.goog",
)
BLOCKED_HOST_SUFFIXES = (".local", ".internal", ".localhost", ".home.arpa", ".in-addr.arpa")
METADATA_ADDRESSES = ("169.254.169.254", "169.254.170.2", "100.100.100.200")
MAX_URL_LENGTH = 2048
MAX_REDIRECTS = 5
BATCH_URLS = 50
REDIRECT_STATUSES = (301, 302, 303, 307, 308)

# --- fixed values: intake bounds ---
MAX_HTML_BYTES = 5 * 1024 * 1024
MIN_HTML_CHARS = 50

# Text bounds of a single-request service. Corpus jobs read whole texts; pass these to
# ``visible_text(max_chars=...)`` / ``keyword_tokens(max_chars=...)`` to reproduce the bounds.
SERVICE_TEXT_CHARS = 120_000
SERVICE_KEYWORD_CHARS = 60_000

# --- fixed values: list lengths of the reports ---
TOP_WORDS = 20
TOP_HOSTS = 10
HISTORY_ROWS = 20
PRICE_POINTS = 60

# --- fixed values: requests allowed per client, route and minute ---
DEFAULT_RATE_LIMIT = 60
ROUTE_RATE_LIMITS = {"analyze": 40, "batch": 10, "scrape": 20, "login": 5}
FREE_ANALYSES_PER_MONTH = 50
