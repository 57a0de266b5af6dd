"""Word lists, lookup tables, patterns, budgets and weights.

Everything in this module is a constant that results depend on.  The values are
stated plainly and in their natural order; no other module hides a constant.
"""

from __future__ import annotations

# --- fixed values: tokens -----------------------------------------------------

MIN_TOKEN_CHARS = 2

STOP_WORDS = (
    # German function words
    "der die das den dem des ein eine einen einem einer eines "
    "und oder aber doch ist war sind waren sein wird werden wurde "
    "von vom zu zum zur in im an am auf für mit ohne "
    "nicht kein keine auch nur noch schon wenn dass als wie "
    "bei nach vor über unter aus durch gegen um "
    # English function words
    "the a an and or but is are was were be been being "
    "to of in on at by for with from as that this these "
    "those it its not no if then than so do does did"
).split()

GERMAN_DIGRAPHS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"),
                   ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue"))

# Suffixes are tried in this order, German before English; the first that fits wins.
GERMAN_SUFFIXES = (
    "erungen ierung ungen ierens ieren iert lich isch ung keit heit schaft ern "
    "end ten ein ene enem enen ener enes em en er es et te st n e s"
).split()
ENGLISH_SUFFIXES = (
    "ization isation ational tional ization ingly ation ments ement ness ously ously "
    "ize ise ing ies ied est ers ed ly es er s"
).split()
MIN_STEM_CHARS = 4

# --- fixed values: BM25, fusion, rerank ----------------------------------------

BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
RRF_K = 60
RRF_BONUS_FIRST = 0.05
RRF_BONUS_NEXT_TWO = 0.02
WEIGHT_LEXICAL = 1.0
WEIGHT_DENSE = 2.0
ARM_DEPTH = 40
RERANK_DEPTH = 30
RERANK_TIERS = ((3, 0.25), (10, 0.40))   # (rank below, weight of the second score)
RERANK_TAIL_WEIGHT = 0.50
RERANK_DOC_CHARS = 4000
EMBED_CHARS = 8000
EMBED_BATCH = 64
EMBED_RETRY_CHARS = (4000, 2000, 1000, 500)
PREVIEW_CHARS = 320

# --- fixed values: chunking -----------------------------------------------------

MAX_CHUNK_CHARS = 4000
MIN_CHUNK_CHARS = 80
OVERLAP_CHARS = 300
PIECE_CHARS = 40000
LEGAL_HEADINGS_NEEDED = 3
LANG_SAMPLE_CHARS = 4000
CHUNK_LANG_MARKERS = {
    "de": (" der ", " die ", " und ", " ist ", "ä", "ö", "ü", "ß"),
    "en": (" the ", " and ", " of ", " to ", " is "),
}

# --- fixed values: language vote ------------------------------------------------

VOTE_WORDS = {
    "de": ("der die das und oder ist sind ein eine einen einem einer für mit von nicht "
           "auch wie was welche welcher welches wann warum wird werden muss darf kann bei "
           "zum zur dem den des auf im nach über unter gibt sich").split(),
    "en": ("the and or is are a an of to for with from not also how what which when why "
           "will would be must may can at in on after over under this that does has have").split(),
}
UMLAUT_VOTES = 2

# --- fixed values: dates --------------------------------------------------------

MONTH_NUMBERS = {
    "januar": 1, "februar": 2, "märz": 3, "maerz": 3, "april": 4, "mai": 5, "juni": 6,
    "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
}
DATE_HEAD_CHARS = 4000
DATE_REACH_CHARS = 40
# Cues from strongest to weakest. W stands for a word boundary.
DATE_CUES = (
    r"in\s+kraft\s+getreten",
    r"in\s+kraft\s+(?:am|ab|treten)",
    r"g[üu]ltig\s+ab",
    r"g[üu]ltig\s+seit",
    r"fassung\s+vom",
    r"\bstand\b",
    r"ausfertigungsdatum",
    r"\bvom\b",
)
DEFAULT_TTL_DAYS = 365

# --- fixed values: pages, routing, graph ------------------------------------------

SYSTEM_PAGES = ("index.md", "log.md", "DESCRIPTION.md")
SLUG_STOP_WORDS = "of the and a an to in for on with md der die das und von im".split()
PAGE_PREFIXES = ("concept", "entity", "summary", "report", "insight")
PAGE_TYPE_GROUPS = ("concept", "entity", "source-summary", "comparison", "insight")
TERM_OVERLAP = 0.7
MAX_KEY_TERMS = 12
MAX_READABLE_FACTS = 5
SHARED_SOURCE_MAX_PAGES = 8
FACT_UNITS = ("%", "mSv", "µSv", "uSv", "Sv", "mGy", "Gy", "Bq", "kg", "km", "mm", "cm", "gb",
              "tb", "mb", "days?", "jahre?", "years?", "hours?", "tokens?", "mio", "mrd")
FACT_CONTEXT_CHARS = 40
PAGE_FORMAT_VERSION = "0.1"
DESCRIPTION_CHARS = 160
OVERVIEW_CHARS = 1800

# --- fixed values: query budgets ---------------------------------------------------

AFFECTED_HITS = 20
AFFECTED_PAGES = 5
CANDIDATE_HITS = 15
CANDIDATE_PAGES = 10
ANSWER_PAGES = 5
LINK_SEEDS = 3
LINK_NEIGHBOURS = 3
TOOL_LINK_NEIGHBOURS = 5
CHUNKS_PER_PAGE = 2
ANSWER_CHARS = 8000
ANSWER_CHARS_PER_DB = 2500
PAGE_BODY_CHARS = 1500
MERGE_CHARS_BY_RANK = (4000, 2000, 2000, 800, 800)
MIN_HITS_PER_DB = 3
PAGE_SEARCH_HITS = 30
READ_WINDOW_CHARS = 16000
PAGE_READ_CHARS = 4000
WEB_RESULT_CHARS = 2000
WEB_PAGE_CHARS = 4000
QUESTIONS_PER_SOURCE = 5
CHAT_MIN_WORDS = 300
CHAT_MIN_SOURCES = 2
REPORT_MIN_WORDS = 600
REPORT_MIN_SOURCES = 4
READS_BEFORE_NUDGE = 2

# --- fixed values: retrieval metrics --------------------------------------------------

PRECISION_AT = 5
RECALL_AT = 10
