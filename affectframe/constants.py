"""Default vocabularies and thresholds of the toolkit.

Everything here is a *value*: the operators take each of them as a parameter.
"""

from __future__ import annotations

# --- Fixed values: results depend on these being exactly as they are --------

# Words around anniversaries, mourning and congratulation. Regular expressions
# over lower-cased text; each has to match between two word boundaries.
MEMORIAL_PATTERNS = (
    "sayg[ıi]",
    "minnet",
    "(rahmet|an[ıi]yoruz|özlemle)",
    "şehit(ler(i|imizi)?|imiz|i)?",
    "taziye",
    "vefat",
    "mekan[ıi] cennet",
    "(allah rahmet eylesin|ruh[lu]ar[ıi] şad olsun)",
)
CELEBRATION_PATTERNS = (
    "tebrik(ler| ederim| ediyoruz)?",
    "kutlu olsun",
    "iyi ki",
    "başarılar",
    "nice yıllara",
    "mutlu yıllar",
    "doğum gün(ü|ün) kutlu olsun",
    "yaş gün(ü|ün) kutlu olsun",
    "bayram(ınız)? kutlu olsun",
    "23 nisan",
    "19 may[ıi]s",
    "30 a[ğg]ustos",
    "29 ek[ıi]m",
    "cumhuriyet bayram[ıi]",
    "zafer bayram[ıi]",
    "mill[iı] bayram[ıi]",
    "sevincini paylaşıyoruz",
)

# Substrings that mark a post as an event announcement.
EVENT_KEYWORDS = (
    "millet buluşması", "millet buluşma", "buluşma",
    "miting", "büyük miting", "gençlik buluşması",
    "kadın buluşması", "aile buluşması",
    "seçim mitingi", "seçim buluşması",
    "halk buluşması", "birlik mitingi",
    "destekçi buluşması", "kardeşlik buluşması",
    "aday tanıtım", "aday lansman",
    "toplu açılış", "açılış töreni",
    "proje tanıtım", "basın toplantısı",
    "ziyaret etti", "ziyaretimiz", "ziyaret",
    "protokol", "resmi tören", "tören",
    "konuşma yaptı", "konuşmamız", "açıklama yaptı",
)

# Words of one or two letters that survive cleaning.
KEPT_SHORT_WORDS = ("ve", "ya", "da", "ki", "mi", "mu", "mü")

# Inclusive code point ranges removed as pictographs.
PICTOGRAPH_RANGES = (
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF),
    (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF),
    (0x2702, 0x27B0),
    (0x24C2, 0x1F251),
)

# Topic names: native spelling -> code. Order is the candidate order.
TOPICS = {
    "göç": "migration",
    "ekonomi": "economy",
    "eğitim": "education",
    "sağlık": "health",
    "adalet": "justice",
    "dış politika": "foreign_policy",
    "enerji": "energy",
    "yerel yönetim": "local_government",
    "taziye": "condolence",
    "tebrik": "congratulation",
    "kültür": "culture",
    "spor": "sports",
    "afet": "disaster",
    "genel": "general",
}
UNCERTAIN = "uncertain"
TOPIC_THRESHOLD = 0.5

EMOTIONS = ("Anger", "Disgust", "Fear", "Happy", "Sadness", "Surprise")
LABEL_THRESHOLD = 0.70
MAX_LABELS = 2
TOP_LABELS = 3

# Analysis defaults.
EXCLUDED_TOPICS = ("condolence", "congratulation")
FOCUS_TOPICS = ("economy", "migration", "health", "justice")
SERIES_EMOTIONS = ("Anger", "Happy")
EVENT_DATE = "2023-05-14"
EVENT_PARTIES = ("MHP", "CHP", "DEM")
SMALL_SHARE = 0.02
MONTHLY_AFTER_DAYS = 90
COLLECT_FROM = "2021-01-01"

# Column names probed for a date, first hit wins.
DATETIME_COLUMNS = ("date", "created_at", "createdAt", "timestamp", "Datetime", "Date")

# Spellings that a CSV reader of the data-frame world takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Limits of our own ------------------------------------------------------

# A side of a join is broadcast only if measured to be at most this large.
BROADCAST_BYTES = 128 * 1024 * 1024
# Label sets are the only thing read back to the driver; more than this is an error.
MAX_CLASSES = 1_000
# A key is hot with at least this part of all rows: there are at most HOT_PARTS such keys.
HOT_PARTS = 10_000
# Slices of a group that is ranked.
SALTS = 32
