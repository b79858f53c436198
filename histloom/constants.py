"""Fixed values. Word lists, codes, weights, headings and limits that results depend on."""

# --- character classes -------------------------------------------------------------------
# The characters that count as white space (Java regex class body).
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same characters one by one.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The characters that make up a word (Java regex class body).
WORD = r"\p{L}\p{N}_"

# Terminal escape sequences.
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"

# --- sentence scoring --------------------------------------------------------------------
# Signal words and phrases, one group per class, in order.
SIGNAL_WORDS = [
    "because|since|so|therefore|however|but|although|though|despite|yet",
    "returned|return|refund|kept|repurchase|buy again|won't buy|wouldn't buy|recommend|recommended",
    "price|expensive|cheap|worth|value|overpriced",
    "quality|smell|scent|texture|fit|size|battery|durable|comfortable|easy|hard",
    "love|hate|amazing|terrible|awful|great|perfect|disappointed",
]
SIGNAL_NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
SIGNAL_POINTS = 2
LENGTH_BONUS_CAP = 200
LENGTH_BONUS_STEP = 80
EXCERPT_CHARS = 900
EXCERPT_MIN_SENTENCES = 2
EXCERPT_ENOUGH = 0.7

# --- splits and caps ---------------------------------------------------------------------
# Users per category, reviews per user, first indexes of validation and test.
TARGET_USERS = 30
REVIEWS_PER_USER = 5
SPLIT_CUTS = (26, 29)
# Community thresholds and split sizes.
MIN_COMMUNITIES = 3
POSTS_PER_COMMUNITY = 5
MIN_POST_CHARS = 50
DELETED_AUTHOR = "[deleted]"
COMMUNITY_SPLIT = (50, 20, 10)
COMMUNITY_SPLIT_SHARES = (0.7, 0.9)
CORPUS_CHARS = 4000
COMMUNITY_CORPUS_CHARS = 2000
# Tasks drawn per level.
TASKS_PER_LEVEL = {1: 10, 2: 10, 3: 5}

# --- value vector ------------------------------------------------------------------------
# The nine values, in order.
VALUE_NAMES = [
    "POWER", "ACHIEVEMENT", "HEDONISM", "STIMULATION", "UNIVERSALISM",
    "BENEVOLENCE", "TRADITION", "CONFORMITY", "SECURITY",
]
# Signal column -> code in the coded text.
SIGNAL_CODES = {
    "val_power": "c2.156",
    "val_achievement": "c5.7",
    "val_hedonism": "c2.152",
    "val_stimulation": "c2.17",
    "val_universalism": "c25.4",
    "val_benevolence": "c25.6",
    "val_tradition": "c25.10",
    "val_conformity": "c25.8",
    "val_security": "c25.2",
    "backup_social": "c5.31",
    "backup_risk": "c5.46",
    "backup_anger": "c5.10",
}
LOCATION_MARK = "#US#"
WINDOW_DAYS = 3
SOCIAL_PRESENT = 0.001
FLAT_PRIOR = 0.11
# Calibration weights.
VALUE_WEIGHTS = {
    "POWER": 0.25, "ACHIEVEMENT": 0.30, "HEDONISM": 0.50, "STIMULATION": 0.50,
    "SECURITY": 3.0, "CONFORMITY": 2.5, "TRADITION": 2.0, "BENEVOLENCE": 2.0,
    "UNIVERSALISM": 2.5,
}
# Population means.
VALUE_MEANS = {
    "POWER": 0.3815, "ACHIEVEMENT": 0.2319, "HEDONISM": 0.0735, "STIMULATION": 0.0883,
    "UNIVERSALISM": 0.0226, "BENEVOLENCE": 0.0331, "TRADITION": 0.0387,
    "CONFORMITY": 0.0427, "SECURITY": 0.0875,
}
DEFAULT_MEAN = 0.01

# --- questionnaire -----------------------------------------------------------------------
# Trait -> item numbers.
TRAIT_ITEMS = {
    "UNIVERSALISM": [3, 8, 19, 23, 29, 40],
    "BENEVOLENCE": [12, 18, 27, 33],
    "TRADITION": [9, 20, 25, 38],
    "CONFORMITY": [7, 16, 28, 36],
    "SECURITY": [5, 14, 21, 31, 35],
    "POWER": [2, 17, 39],
    "ACHIEVEMENT": [4, 13, 24, 32],
    "HEDONISM": [10, 26, 37],
    "STIMULATION": [6, 15, 30],
    "SELF_DIRECTION": [1, 11, 22, 34],
}
ALIGNED_FULL = 4.5
ALIGNED_HALF = 3.5

# --- scoring -----------------------------------------------------------------------------
MIN_QUOTE_CHARS = 12
ENTAILMENT_GATE = 0.3
NEW_CLAIM_COST = 0.25
# The penalties that the rating model is tried with.
RATING_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]

# --- interactions ------------------------------------------------------------------------
# Click type -> interaction type.
INTERACTION_TYPES = {"purchase": "purchase", "cart_side_bar": "cart", "product_link": "click"}
# Section order and headings.
SECTION_HEADINGS = {
    "purchase": "**Purchased Products:**",
    "cart": "**Items Added to Cart (but not bought):**",
    "click": "**Clicked / Viewed Items:**",
}
# Defaults for keys that a product record lacks.
MISSING_ITEM_ID = "0000000000"
MISSING_TITLE = "Unknown Title"
MISSING_PRICE = "Unknown Price"
# Texts that stand for no text, and the actions of a log that count as browsing.
EMPTY_TEXTS = ["", "nan", "none", "null"]
BROWSE_ACTIONS = ["click", "product_link", "quantity", "purchase", "cart_side_bar"]

# Phrases for traits that purchases alone cannot show.
NON_INFERABLE = [
    "read review", "reading review", "reviews with image", "negative review",
    "positive review", "examines review", "focuses on review", "checks review",
    "review strategy", "detailed review", "star rating", "ratings and review",
    "product's rating", "value a product's rating", "customer review",
    "view multiple", "views multiple", "browsing", "compares options",
    "time researching", "researching product", "comparing product",
    "shopping process", "search behavior", "filtering", "decision-making process",
    "sponsored product", "sponsored listing", "advertisement", "ad awareness",
    "promoted product", "paid placement", "hold negative stereotypes against sponsored",
    "ai tool", "rufus", "ai-generated", "chatbot", "virtual assistant",
    "review summar", "ai tools like",
    "time-consuming", "quick decision", "impulse", "deliberate",
    "return policy", "considers return", "difficult or time",
    "chatgpt", "gpt recommendation", "ai recommendation",
]

# --- page elements -----------------------------------------------------------------------
# Words that mark an action.
ACTION_WORDS = [
    "login", "sign in", "search", "submit", "next", "continue", "apply",
    "advanced", "filter", "checkout", "add to cart", "buy", "click",
    "download", "upload", "save", "cancel", "confirm", "select", "choose",
    "go", "enter", "find", "browse", "navigate", "access", "open", "view",
    "show", "hide", "expand", "collapse", "more", "less", "all", "none",
]
# Codes of tags and roles.
TAG_CODES = {"a": 0, "button": 1, "input": 2, "select": 3, "textarea": 4, "div": 5, "span": 6}
ROLE_CODES = {"link": 0, "button": 1, "textbox": 2, "combobox": 3, "option": 4, "text": 5}
# Texts of a search field.
SEARCH_TEXTS = ["", "search", "search..."]
TOP_ELEMENTS = 16
ELEMENT_TEXT_CHARS = 24
ELEMENT_LINE_CHARS = 30

# --- survey text -------------------------------------------------------------------------
# Survey section -> heading, in order.
SURVEY_SECTIONS = {
    "Demographic Information": "**Demographics:**",
    "Self Description": "**Self Description:**",
    "Shopping Preference": "**Shopping Preferences:**",
    "Personality": "**Personality:**",
}
# Headings of a survey text.
SURVEY_TITLE = "### Survey Information"
RAW_SURVEY_HEADING = "**Survey Data:**"

# --- pages and documents -----------------------------------------------------------------
CHUNK_CHARS = 1024
LINKS_PER_REQUEST = 3
# Elements that start a new line of text.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td",
    "tfoot", "th", "thead", "title", "tr", "ul",
]
