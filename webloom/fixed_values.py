"""Word lists, limits and thresholds that define the results.

They are data, not tuning knobs: changing one changes what a query returns.
"""

from __future__ import annotations

# --- URLs -----------------------------------------------------------------
HTTP_SCHEMES = ("http", "https")

UNWANTED_EXTENSIONS = (
    ".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".mp3", ".mp4", ".avi", ".wav", ".zip", ".rar", ".tar", ".gz",
    ".ttf", ".otf", ".woff", ".woff2", ".eot", ".ico", ".txt", ".xml", ".json",
)

SKIPPED_HREF_PREFIXES = ("mailto", "tel", "javascript", "data")

URL_COLUMN_NAMES = ("url", "urls", "link", "links", "address")

DISPLAY_URL_LENGTH = 80

# --- page structure -------------------------------------------------------
EXCLUDED_TAGS = ("header", "footer", "nav", "aside", "dialog")

EXCLUDED_ROLES = (
    "banner", "contentinfo", "navigation", "menu", "menubar", "complementary", "dialog",
)

IDENTIFIER_ATTRIBUTES = (
    "id", "class", "aria-label", "data-testid", "data-component", "data-section", "name",
)

EXCLUDED_TOKENS = (
    "header", "footer", "masthead", "navbar", "nav-bar", "navigation", "navigator",
    "menu", "menubar", "drawer", "sidebar", "offcanvas", "off-canvas",
    "breadcrumb", "breadcrumbs", "toolbar", "tabbar", "tab-bar",
    "mobile-nav", "desktop-nav", "mobile-menu", "desktop-menu",
    "top-nav", "bottom-nav", "site-nav", "primary-nav", "secondary-nav", "main-nav",
    "site-header", "site-footer", "main-header", "main-footer", "top-header",
    "bottom-footer",
)

EXCLUDED_COMPOUND_WORDS = (
    "header", "footer", "nav", "navbar", "navigation", "menu", "menubar", "drawer",
    "sidebar", "offcanvas", "breadcrumb", "toolbar", "tabbar",
)

OVERLAY_CLASSES = ("fixed", "sticky")
OVERLAY_EDGE_CLASSES = ("inset-0", "top-0", "bottom-0")
OVERLAY_MIN_LINKS = 4

# The older exclusion rule looks at id and class only.
LEGACY_EXCLUDED_TAGS = ("header", "footer", "nav")
LEGACY_EXCLUDED_ROLES = ("banner", "contentinfo", "navigation")
LEGACY_EXCLUDED_NAMES = (
    "header", "footer", "site-header", "site-footer", "main-header", "main-footer",
    "top-header", "bottom-footer", "navbar", "nav-bar", "navigation",
    "main-navigation", "primary-navigation", "secondary-navigation",
    "main-menu", "primary-menu", "secondary-menu",
    "menu-container", "menu-wrapper", "mobile-menu", "desktop-menu",
)
LEGACY_EXCLUDED_WORDS = ("header", "footer", "navigation", "navbar")

# Content roots, second priority group: classes and ids.
CONTENT_CLASSES = (
    "entry-content", "post-content", "article-content", "single-post-content",
    "single-content", "page-content", "main-content", "content-area",
)
CONTENT_IDS = ("main-content", "content")

# Layout elements left out of the main text.
LAYOUT_TAGS = (
    "header", "footer", "nav", "aside", "script", "style", "noscript",
    "form", "iframe", "svg", "canvas", "template", "dialog",
)
LAYOUT_ROLES = ("navigation", "banner", "contentinfo", "complementary")
LAYOUT_CLASSES = (
    "sidebar", "side-bar", "menu", "navbar", "breadcrumb", "breadcrumbs", "cookie",
    "popup", "modal", "social-share", "share-buttons", "related-posts",
    "related-articles", "comments",
)
LAYOUT_IDS = ("sidebar", "side-bar", "menu", "navbar", "cookie", "comments")

# --- link report ----------------------------------------------------------
SITEWIDE_LINK_PERCENT = 60
MIN_SITEWIDE_LINK_SOURCES = 3
NOT_CHECKED = "Not checked"

# --- fetch log ------------------------------------------------------------
RETRY_STATUSES = (429, 503)
BLOCK_STATUSES = (429, 503, 403)
MAX_RETRIES_PER_URL = 3
BACKOFF_BASE_SECONDS = 30
BACKOFF_MAX_SECONDS = 300
MAX_CONSECUTIVE_BLOCKS = 5

# --- prompt documents -----------------------------------------------------
REPLY_KEYS = ("response", "text", "content", "message")
FAILED_REPLY = "**Failed to generate structure**"

# --- motion ---------------------------------------------------------------
MEDIA_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".h264", ".264", ".m4v", ".ts", ".dav")
ALGORITHM_VERSION = "webloom-motion-1"
SENSITIVITY_FACTORS = {"low": 1.6, "medium": 1.0, "high": 0.7}
BOX_TOUCH_PIXELS = 12
MIN_CONTOUR_AREA = 9
HIGH_MIN_SAMPLES = 3
UNASSESSABLE_RATIO = 0.95
WARN_DECODE = "Frame decode failure"
WARN_TRUNCATED = "Video ended before advertised frame count; possibly truncated"
WARN_FEW_SAMPLES = "Too few sampled frames for reliable analysis"
WARN_UNASSESSABLE = (
    "View matches manually designated unavailable scene in >=95% of samples; "
    "motorcycle visibility cannot be assessed"
)
ERROR_FRAME_RATE = "Unknown frame rate; timing cannot be established safely"
ERROR_RESOLUTION = (
    "Resolution differs from selected camera profile; select/create correct profile"
)
ERROR_NO_FRAMES = "No readable frames; unsupported codec or corrupt file"
