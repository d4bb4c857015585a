"""Fixed values of the retrieval rules: they decide results and are given as they are."""

# Tokens that tokenising leaves out.
STOP_WORDS = (
    "של את על עם או לא כי אם גם מה זה זו אל הם הן אנו היא הוא כל יש אין בין לפי אך רק עד כן לו כך אחר "
    "היה היו להיות כאשר אשר בו מן ביותר ידי שם שלא למה איך מתי איפה כמה לפני אחרי תחת מעל בגלל בשביל למען לגבי בתוך מחוץ "
    "the a an is are was were be been being have has had do does did will would shall should may might must can could "
    "to of in for on with at by from as into about and or but if not no so it its this that these those he she we they i you"
).split()

# Letters that may stand before a word as a prefix.
PREFIX_LETTERS = "והבכלמש"

# A section begins at the start of a line with one of these.
SECTION_START = r"(?:סעיף\s+\d+|פרק\s+[א-ת]|\d+\.\s|\d+\)\s)"
SECTION_REFERENCE = r"(?:סעיף|תקנה)\s+\d+(?:\([^\s)]+\))*"
CIRCULAR_REFERENCE = r"\d{4}-\d+-\d+"
PERCENTAGE = r"\d+%"
PARAGRAPH_LABEL = "קטע"
PART_LABEL = "חלק"

# Questions that are asked again with a focus: (all of these, groups of (label, any of these), least groups, query).
EXPANSIONS = [
    {
        "all": ["זכויות עמית"],
        "groups": [("העברה", ["העברה", "העברת כספים"]), ("שעבוד", ["שעבוד"]), ("עיקול", ["עיקול"])],
        "least": 2,
        "query": "{label} זכויות עמית חוק הפיקוח על קופות גמל סעיף 25",
    },
    {
        "all": ["הלוואה", "קרן השתלמות"],
        "queries": [
            "הלוואה לעמית מקרן השתלמות תנאים חוזר 2016-9-17 סעיף 8(ד)",
            "הלוואה כנגד כספים נזילים ולא נזילים קרן השתלמות 50% 80% שבע שנים",
        ],
    },
]

# Evidence that questions with all of these words must see.
FORCED = {
    "all": ["הלוואה", "קרן השתלמות"],
    "markers": ["50%", "80%", "50 אחוז", "80 אחוז", "50 אחוזים", "80 אחוזים", "שבע שנים", "7 שנים", "8(ד)"],
}

# Authority of a document by its type, or by what its title contains first in this order.
AUTHORITY_TITLES = [("חוק", "חוק"), ("תקנ", "תקנה"), ("חוזר", "חוזר"), ("הכרעה", "הכרעה")]
AUTHORITY_OTHER = "אחר"
AUTHORITY_BONUS = {"חוק": 0.040, "תקנה": 0.020, "חוזר": 0.010, "הכרעה": 0.008, "אחר": 0.0}
AUTHORITY_TERMS = ["זכויות", "העברה", "שעבוד", "עיקול", "איסור", "מותר", "אסור"]

VALIDITY_LABELS = {"superseded": "הוחלף במסמך עדכני", "expired": "פג תוקף"}
EFFECTIVE_LABEL = "תוקף"

# Questions about a yearly parameter: the subject, and any of the terms.
PARAMETER_SUBJECT = "קרן השתלמות"
PARAMETER_TERMS = ["תקרה", "סכום", "הפקדה מוטבת", "הפקדה המוטבת", "עדכני", "כמה", "שנה"]
PARAMETER_KEY = "training_fund_favored_deposit_limit"
PARAMETER_PHRASE = "הפקדה מוטבת"

FOLLOW_UP_MARKERS = [
    "מה עם", "ומה לגבי", "תפרט", "תרחיב", "השורה התחתונה", "בקיצור", "לסכם", "תסכם", "למעשה", "אז מה", "ואם", "ובמקרה", "ולגבי", "איך זה", "למה",
]
FOLLOW_UP_WORDS = 12

# Words of evidence blocks and of the list of sources.
PAGE, PAGES, NO_PAGE, NO_SECTION = "עמוד", "עמודים", "עמוד לא זמין במאגר הישן", "קטע ללא כותרת"
DOCUMENT_WORD, SECTION_WORD = "מסמך", "סעיף"
PARAMETER_BLOCK = (
    "[[TAX-PARAM-{tax_year}]]\nפרמטר מס רשמי לשנת המס {tax_year}: {value_text} ₪ לשנה.\nמפתח: {parameter_key} | יחידה: {unit}\nמקור: {source_title} | עמוד: {source_page}\n"
    "URL: {source_url}\nסוג מקור: {source_type}\nיש לציין בתשובה את שנת המס ואת המקור.\n[[/TAX-PARAM]]"
)
PARAMETER_NO_PAGE, PARAMETER_SOURCE_TYPE = "לא זמין", "official"
SOURCES_TITLE, SOURCE_WORD = "מקורות שנשלפו", "מקור"
CUT_TITLE, CUT_TEXT = " (קטוע)", "\n[... המסמך נחתך עקב מגבלת גודל ...]"

# What evidence and questions are introduced with.
EVIDENCE = "להלן קטעים רלוונטיים מהמסמכים הרגולטוריים:"
FOLLOW_UP_EVIDENCE = "(הקשר נוסף מהמסמכים — השתמש רק אם רלוונטי לשאלת ההמשך):"
FOLLOW_UP_QUESTION = "שאלת המשך"

# The row that a new table of parameters begins with.
FIRST_PARAMETER = {
    "parameter_key": "training_fund_favored_deposit_limit",
    "tax_year": 2026,
    "value_text": "20,566",
    "unit": "ILS_PER_YEAR",
    "source_title": "לוח עזר לחישוב מס הכנסה — ינואר 2026 ואילך",
    "source_url": "https://www.gov.il/BlobFolder/generalpage/income-tax-monthly-deductions-booklet/he/generalInformation_income-tax-monthly-deductions-booklet_monthly-deductions-booklet-2026.pdf",
    "source_page": "12",
    "source_type": "official",
}

# Classes of sources, and the words of a sheet for reviewing cases.
OFFICIAL_CLASS = "מקור רשמי / ממשלתי — מועמד חזק לקורפוס"
CONSTRUCTED_CLASS = "מקרה clarification שנבנה אצלנו — לא מסמך להוספה"
SECONDARY_CLASS = "מקור משני — צריך לאמת מול מקור רגולטורי ראשוני"
REVIEW_KIND, REVIEW_NO_KIND, REVIEW_CLASS = "סוג מקור", "לא צוין", "סיווג"
REVIEW_SOURCE, REVIEW_PRIMARY = "מקור", "מקור ראשוני מזוהה"
REVIEW_ANSWER, REVIEW_NO_ANSWER = "תשובת ייחוס", "אין תשובת ייחוס"
REVIEW_CONCLUSION, REVIEW_CONCEPTS, REVIEW_ACTIONS = "מסקנה צפויה", "מושגים/תנאים שחייבים להופיע", "פעולה צפויה"
REVIEW_PROHIBITED, REVIEW_CLARIFY, REVIEW_YES, REVIEW_STATUS = "טענות שאסור להסיק", "נדרשת הבהרה", "כן", "סטטוס"
REVIEW_PARTS = ("חלק א׳", "חלק ב׳")
REVIEW_DONE = "הורץ מול {product} במסגרת benchmark"
REVIEW_OPEN = "נאסף ל־source bank; טרם הורץ וטרם אושר כ־gold answer"

OFFICIAL_KINDS = ["official_qa", "official", "government", "government_service", "gov.il – רשות המסים"]
CONSTRUCTED_KIND = "constructed_from_web_topics"
QUOTA_CODES = ["insufficient_quota", "credit_balance_exhausted"]

# Prices of a million tokens.
PRICES = {"input": 0.15, "output": 0.60, "cache_read": 0.0375, "cache_write": 0.15}

# Marks of Markdown and the elements for them, in the order in which they apply; {h1} and so on stand for attributes.
MARKDOWN = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"\*(.+?)\*", "<em>$1</em>"),
    (r"`(.+?)`", "<code>$1</code>"),
    (r"(?m)^### (.+)$", '<h3{h3}>$1</h3>'),
    (r"(?m)^## (.+)$", '<h2{h2}>$1</h2>'),
    (r"(?m)^# (.+)$", '<h1{h1}>$1</h1>'),
    (r"(?m)^---$", "<hr>"),
    (r"(?m)^- (.+)$", "<li>$1</li>"),
    (r"(?s)(<li>.*</li>)", '<ul{ul}>$1</ul>'),
    (r"(?m)^\d+\. (.+)$", "<li>$1</li>"),
    (r"\n", "<br>"),
]
