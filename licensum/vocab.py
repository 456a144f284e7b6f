"""Vocabularies of the licensing-register domain.

Every operator takes the list or map it needs as a parameter and uses the value below as its default.
"""

# --- Fixed values: they must equal the published register rules for results to match. ---------------------------

LICENCE_TYPES = ["new", "variation", "transfer", "review", "provisional"]
LICENCE_STATUSES = ["granted", "pending", "refused", "withdrawn", "under_review"]

# Response text -> licence type: first phrase contained wins, otherwise "new".
LICENCE_TYPE_PHRASES = [
    ("variation", "variation"),
    ("transfer", "transfer"),
    ("review", "review"),
    ("provisional", "provisional"),
]
# Response text -> licence status: first phrase contained wins, otherwise "pending".
LICENCE_STATUS_PHRASES = [
    ("granted", "granted"),
    ("approved", "granted"),
    ("refused", "refused"),
    ("rejected", "refused"),
    ("withdrawn", "withdrawn"),
    ("review", "under_review"),
]

# Entities decoded by the text cleaner, in this order.
CLEANER_ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&quot;", '"'),
    ("&#39;", "'"),
]

ADDRESS_ABBREVIATIONS = [
    ("St", "Street"),
    ("Rd", "Road"),
    ("Ave", "Avenue"),
    ("Dr", "Drive"),
    ("Cl", "Close"),
    ("Ln", "Lane"),
    ("Pl", "Place"),
    ("Sq", "Square"),
    ("Ct", "Court"),
]

POSTCODE_PATTERN = r"[A-Z]{1,2}[0-9R][0-9A-Z]?\s*[0-9][A-Z]{2}"

NAME_TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "lady", "lord"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]

ACTIVITY_NAMES = [
    ("sale of alcohol", "Sale of Alcohol"),
    ("supply of alcohol", "Sale of Alcohol"),
    ("retail sale of alcohol", "Sale of Alcohol"),
    ("live music", "Live Music"),
    ("recorded music", "Recorded Music"),
    ("performance of dance", "Performance of Dance"),
    ("entertainment similar to music or dance", "Entertainment Similar to Music or Dance"),
    ("late night refreshment", "Late Night Refreshment"),
    ("provision of late night refreshment", "Late Night Refreshment"),
    ("films", "Exhibition of Films"),
    ("exhibition of films", "Exhibition of Films"),
    ("indoor sporting events", "Indoor Sporting Events"),
    ("boxing or wrestling", "Boxing or Wrestling Entertainment"),
]

DAY_NAMES = {
    "monday": "Monday",
    "mon": "Monday",
    "tuesday": "Tuesday",
    "tue": "Tuesday",
    "tues": "Tuesday",
    "wednesday": "Wednesday",
    "wed": "Wednesday",
    "thursday": "Thursday",
    "thu": "Thursday",
    "thur": "Thursday",
    "thurs": "Thursday",
    "friday": "Friday",
    "fri": "Friday",
    "saturday": "Saturday",
    "sat": "Saturday",
    "sunday": "Sunday",
    "sun": "Sunday",
}

# Names that come from page furniture rather than from a licence.
JUNK_NAME_WORDS = ["loading", "error", "not found", "search", "menu", "navigation"]

# Literal substrings deleted, in this order, before two names or addresses are compared.
MATCH_NOISE = [
    "the ", " ltd", " limited", " plc", " pub", " restaurant", " bar",
    " hotel", " inn", " tavern", " club", " cafe", " coffee", " shop",
]

# Business type: first row whose word is contained in the lower-case premises name.
BUSINESS_TYPE_WORDS = [
    ("Pub", ["pub", "tavern", "inn"]),
    ("Restaurant", ["restaurant", "bistro", "brasserie", "dining"]),
    ("Bar", ["bar", "cocktail", "wine bar"]),
    ("Hotel", ["hotel"]),
    ("Club", ["club", "nightclub"]),
    ("Cafe", ["cafe", "coffee"]),
    ("Retail", ["shop", "store", "market", "supermarket"]),
    ("Entertainment Venue", ["theatre", "cinema", "venue"]),
]
TAKEAWAY_NEEDS = "late night refreshment"
TAKEAWAY_EXCLUDES = "sale of alcohol"

# Licence category: added when any activity contains one of the words.
CATEGORY_WORDS = [
    ("Alcohol", ["alcohol"]),
    ("Entertainment", ["music", "dance"]),
    ("Late Night Refreshment", ["refreshment"]),
    ("Films", ["film"]),
    ("Sports", ["sport"]),
]
DEFAULT_CATEGORY = "General"

# Page vocabulary.
BOILERPLATE_TAGS = ["script", "style", "nav", "header", "footer"]
MAIN_SELECTORS = [
    "main", ".main", "#main", ".content", "#content",
    ".main-content", "#main-content", "article", ".article",
]
LICENCE_CONTENT_PHRASES = [
    "premises licence", "alcohol licence", "entertainment licence",
    "licensing register", "licence application", "licensable activities",
]
LICENCE_LINK_WORDS = [
    "licence", "licensing", "alcohol", "entertainment", "premises", "register", "application",
]
DIAGNOSTIC_WORDS = ["premises licence", "alcohol", "application", "register"]
DIAGNOSTIC_PHRASES = [
    "premises licence", "alcohol licence", "entertainment licence", "licence application", "licence holder",
]
DATA_INDICATORS = [
    "premises name", "licence holder", "address", "granted",
    "application number", "licence number", "status", "pub", "restaurant", "bar",
]
DATA_INDICATORS_SHORT = [
    "premises name", "licence holder", "address", "granted",
    "application number", "licence number", "status",
]
LISTING_LINK_WORDS = ["licence", "register", "search", "database"]
NAV_CLASS_WORDS = ["nav", "menu", "header"]
PAGINATION_CLASS_WORDS = ["pagination", "page-numbers", "next", "previous", "pager"]
PAGINATION_TEXTS = ["page 1 of", "next page", "previous page"]
SPA_FRAMEWORKS = ["angular", "react", "vue", "ember", "backbone"]
DYNAMIC_CLASS_WORDS = ["loading", "spinner", "dynamic"]
OTHER_CMS_WORDS = ["joomla", "typo3", "concrete5"]
TABLE_HEADER_WORDS = [
    "premises", "licence", "alcohol", "entertainment", "name", "address",
    "status", "date", "application", "holder",
]
CARD_CLASS_WORDS = ["licence", "premises", "result", "item", "card", "entry"]
SEARCH_FORM_WORDS = ["licence", "search", "premises"]
COUNCIL_LINK_WORDS = [
    "council", "borough", "city", "district", "county", ".gov.uk", "local", "authority",
]

# Council names and addresses.
COUNCIL_NAME_NOISE = [" council", " city", " borough", " district", " metropolitan", " royal", " ", "-", "'"]
REGION_CODES = [("eng", "England"), ("sct", "Scotland"), ("wls", "Wales")]
URL_BOILERPLATE_TAILS = [
    "If%20this%20URL%20does%20not%20lead%20to%20the%20desired%20information,%20please%20check%20the%20council's"
    "%20website%20directly%20for%20the%20most%20accurate%20and%20updated%20links.",
    "If this URL does not lead to the desired information, please check the council's website directly for the"
    " most accurate and updated links.",
]
URL_REJECTS = ["example.com", "placeholder"]

# name, website, region, code
SEED_COUNCILS = [
    ("Westminster City Council", "https://www.westminster.gov.uk", "London", "WCC"),
    ("Camden Council", "https://www.camden.gov.uk", "London", "CAM"),
    ("Islington Council", "https://www.islington.gov.uk", "London", "ISL"),
    ("Hackney Council", "https://www.hackney.gov.uk", "London", "HAC"),
    ("Tower Hamlets Council", "https://www.towerhamlets.gov.uk", "London", "TWH"),
    ("Southwark Council", "https://www.southwark.gov.uk", "London", "SWK"),
    ("Manchester City Council", "https://www.manchester.gov.uk", "North West", "MCC"),
    ("Birmingham City Council", "https://www.birmingham.gov.uk", "West Midlands", "BCC"),
    ("Leeds City Council", "https://www.leeds.gov.uk", "Yorkshire", "LCC"),
    ("Liverpool City Council", "https://www.liverpool.gov.uk", "North West", "LIV"),
    ("Bristol City Council", "https://www.bristol.gov.uk", "South West", "BRI"),
    ("Newcastle City Council", "https://www.newcastle.gov.uk", "North East", "NEW"),
    ("Sheffield City Council", "https://www.sheffield.gov.uk", "Yorkshire", "SHE"),
    ("Glasgow City Council", "https://www.glasgow.gov.uk", "Scotland", "GLA"),
    ("Edinburgh Council", "https://www.edinburgh.gov.uk", "Scotland", "EDI"),
    ("Cardiff Council", "https://www.cardiff.gov.uk", "Wales", "CAR"),
    ("Swansea Council", "https://www.swansea.gov.uk", "Wales", "SWA"),
]

KNOWN_REGISTER_URLS = {
    "Westminster City Council": "https://www.westminster.gov.uk/licensing",
    "Islington Council": "https://www.islington.gov.uk/business/licensing",
    "Hackney Council": "https://www.hackney.gov.uk/licensing",
    "Manchester City Council": "https://www.manchester.gov.uk/info/200084/licensing",
    "Leeds City Council": "https://www.leeds.gov.uk/business/licensing",
    "Liverpool City Council": "https://liverpool.gov.uk/business/licensing/",
    "Bristol City Council": "https://www.bristol.gov.uk/licences-permits/premises-licences",
    "Sheffield City Council": "https://www.sheffield.gov.uk/home/business/licensing",
    "Newcastle City Council": "https://www.newcastle.gov.uk/services/environmental-health/licensing",
    "Edinburgh Council": "https://www.edinburgh.gov.uk/business/licensing",
}

# --- End of fixed values. ---------------------------------------------------------------------------------------

# Named character references decoded in page text (code points from the HTML standard).
HTML_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "pound": "£", "euro": "€",
    "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«",
    "raquo": "»", "times": "×", "deg": "°", "sect": "§", "para": "¶",
    "frac12": "½", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç",
    "uuml": "ü", "ouml": "ö", "auml": "ä", "larr": "←", "rarr": "→",
}

# Header text -> licence column, tried in order, for rows of a register table.
TABLE_COLUMN_SYNONYMS = [
    ("premises_name", ["premises name", "premises", "trading name", "business name", "name"]),
    ("premises_address", ["premises address", "address", "location"]),
    ("postcode", ["postcode", "post code"]),
    ("licence_type", ["licence type", "application type", "type"]),
    ("licence_status", ["licence status", "application status", "status"]),
    ("application_date", ["application date", "date received", "received", "date"]),
    ("granted_date", ["granted date", "date granted", "granted"]),
    ("designated_premises_supervisor", ["licence holder", "holder", "dps", "designated premises supervisor"]),
    ("licensable_activities", ["licensable activities", "activities"]),
]
