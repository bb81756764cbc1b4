"""Attribute rules. Patterns run on normalised text unless noted."""

ROAST_RULES = [
    (r"\bomni\b", "omni"),
    (r"\b(medium light|light medium)\b", "medium-light"),
    (r"\b(medium dark|dark medium|full city)\b", "medium-dark"),
    (r"\b(light|nordic|filter)\b", "light"),
    (r"\b(dark|french|italian|vienna)\b", "dark"),
    (r"\b(medium|city)\b", "medium"),
]
ROAST_LABEL = r"\broast(?: level| profile)? (omni|medium light|light medium|medium dark|light|medium|dark)\b"
ROAST_PHRASE = r"\b(omni|medium light|light medium|medium dark|light|medium|dark|filter|espresso)(?: roast(?:ed)?)\b"
ROAST_OMNI = r"\bomni roast|\bomniroast\b"

PROCESS_RULES = [
    (r"\bcarbonic( maceration)?\b", "carbonic-maceration"),
    (r"\banaerobic\b", "anaerobic"),
    (r"\b(wet hulled|giling basah)\b", "wet-hulled"),
    (r"\b(honey|pulped natural|semi washed|miel)\b", "honey"),
    (r"\b(natural|naturally|dry process(ed)?|sun dried|unwashed)\b", "natural"),
    (r"\b(washed|wet process(ed)?|fully washed|lavado|kenyan process|double washed)\b", "washed"),
    (
        r"\b(experimental|co ferment(ed)?|infused|thermal shock|koji|yeast|lactic|extended fermentation)\b",
        "other",
    ),
]
# On the raw text: the label needs its punctuation.
PROCESS_LABEL = r"(?i)process(?:ing)?(?: method)?\s*[:\-–—]\s*([^\n|•;]+)"
PROCESS_PHRASE = (
    r"\b(carbonic maceration|anaerobic|wet hulled|giling basah|pulped natural|fully washed|double washed"
    r"|dry processed|sun dried|(?:honey|natural|washed) process(?:ed)?|naturally processed)\b"
)

VARIETY_RULES = [
    (r"\b(gesha|geisha)\b", "gesha"),
    (r"\bpink bourbon\b", "pink bourbon"),
    (r"\bred bourbon\b", "red bourbon"),
    (r"\byellow bourbon\b", "yellow bourbon"),
    (r"\bbourbon\b(?! barrel| cask)", "bourbon"),
    (r"\btypica\b", "typica"),
    (r"\bcaturra\b", "caturra"),
    (r"\bcatuai\b", "catuai"),
    (r"\bpacamara\b", "pacamara"),
    (r"\bpacas\b", "pacas"),
    (r"\bsl ?28\b", "sl28"),
    (r"\bsl ?34\b", "sl34"),
    (r"\bruiru ?11\b", "ruiru11"),
    (r"\bbatian\b", "batian"),
    (r"\b(heirloom|landrace|ethiopian heirloom|jarc|74110|74112|74158)\b", "ethiopian landrace"),
    (r"\bcastillo\b", "castillo"),
    (r"\bmaragogype\b", "maragogype"),
    (r"\bmundo novo\b", "mundo novo"),
    (r"\bcatimor\b", "catimor"),
    (r"\bsarchimor\b", "sarchimor"),
    (r"\bparainema\b", "parainema"),
    (r"\blaurina\b", "laurina"),
    (r"\bwush wush\b", "wush wush"),
    (r"\bsidra\b", "sidra"),
    (r"\bvilla sarchi\b", "villa sarchi"),
    (r"\btabi\b", "tabi"),
    (r"\bmokka\b", "mokka"),
    (r"\bmarsellesa\b", "marsellesa"),
    (r"\bobata\b", "obata"),
    (r"\bicatu\b", "icatu"),
    (r"\bchiroso\b", "chiroso"),
    (r"\bjava variety\b", "java"),
]
# A value ending in this suffix suppresses the bare value.
VARIETY_SUPPRESS = "bourbon"

# On the raw text.
NOTE_LABEL = (
    r"(?i)(?:tasting notes?|flavou?r notes?|cup(?:ping)? notes?|notes? of|we taste|tastes? like|in the cup"
    r"|flavou?rs?|notes?)\s*[:\-–—]\s*([^\n]+)"
)
NOTE_SEPARATOR = r"(?i)\s*(?:,|/|\||•|;|&|\+|\band\b)\s*"
NOTE_EDGE = "^[\\s\"'“”]+|[\\s\"'“”.]+$"
NOTE_FILLER = "(?i)^(with|hints?|notes?)$"
DECAF = (
    r"(?i)\b(decaf|decaffeinated|swiss water|sugar ?cane (process|decaf)|ea process|mountain water|co2 decaf)\b"
)
BLEND = r"(?i)\bblend\b"

SIZE = r"(\d+(?:\.\d+)?)\s*(kg|kilo|grams?|gr|g|ounces?|oz|lbs?|pounds?)\b"
UNIT_GRAMS = {
    "g": 1.0,
    "gram": 1.0,
    "grams": 1.0,
    "gr": 1.0,
    "kg": 1000.0,
    "kilo": 1000.0,
    "oz": 28.3495,
    "ounce": 28.3495,
    "ounces": 28.3495,
    "lb": 453.592,
    "lbs": 453.592,
    "pound": 453.592,
    "pounds": 453.592,
}

# Product classifier.
PRODUCT_INCLUDE = (
    r"\b(coffee|coffees|beans?|single origins?|blend|espresso|decaf|roast|roasted|filter roast|omni roast"
    r"|microlot|micro lot|natural process|washed process)\b"
)
PRODUCT_EXCLUDE = (
    r"\b(mugs?|tee|t shirt|shirt|hoodie|sweatshirt|hat|beanie|cap|tote|bag clip|apparel|merch|gear|grinder"
    r"|kettle|filter papers?|paper filters?|dripper|brewer|chemex|v60|aeropress|french press|scale|gift cards?"
    r"|giftcard|subscriptions?|subscribe|sticker|tumbler|equipment|accessor(y|ies)|chocolate bar|candle|pods?"
    r"|capsules?|nespresso|k cups?|instant|concentrate|cans?|canned|drip bags?|syrup|workshop|gift box|gift set"
    r"|bundle)\b"
)
PRODUCT_EXCLUDE_TYPE = (
    r"\b(tea|teas|matcha|chai|merch|merchandise|apparel|equipment|gear|brewing|accessories|gift card"
    r"|subscription)\b"
)
PRODUCT_INCLUDE_TITLE = (
    r"\b(ethiopia|kenya|colombia|guatemala|brazil|peru|honduras|rwanda|burundi|costa rica|el salvador|panama"
    r"|mexico|nicaragua|sumatra|yemen|ecuador|bolivia|uganda|tanzania|congo)\b"
)

# Place discovery.
PRIMARY_CATEGORIES = ["coffee_shop", "coffee_roastery", "cafe"]
ALTERNATE_CATEGORIES = ["coffee_shop", "coffee_roastery"]
ROASTER_CATEGORIES = ["coffee_roastery"]
ROASTER_NAME = r"\broast(er|ers|ery|eries|ing|works)\b"
INSPECT_NAME = "coffee|espresso|roast|cafe|café"
INSPECT_CATEGORY = ["%coffee%", "%cafe%"]
CLOSED_STATUSES = ["permanently_closed", "closed"]
MIN_CONFIDENCE = 0.5
DEDUPE_METERS = 50.0
MULTI_LOCATION_THRESHOLD = 5
DENY_NAMES = [
    "Starbucks",
    "Dunkin'",
    "Peet's Coffee",
    "Tim Hortons",
    "Dutch Bros",
    "Caribou Coffee",
    "Pret A Manger",
    "Panera Bread",
    "McCafé",
    "Costa Coffee",
]

# Page links, on path + anchor text in lower case.
LINK_SKIP_PATH = (
    r"(?i)/(cart|checkout|account|login|signin|register|wishlist|search|policies|policy|privacy|terms|blog|news"
    r"|careers|jobs|wholesale-login|gift-card|subscriptions?)(/|$)"
)
LINK_SKIP_EXT = r"(?i)\.(jpe?g|png|gif|webp|svg|mp4|mov|zip|docx?|xlsx?)$"
LINK_PDF_HINT = "menu|drink|cafe|café|bar"
LINK_RULES = [
    (r"\bmenus?\b|/menu", "menu"),
    (r"\b(coffees?|beans?|single[- ]origins?|blends?|espresso)\b|/coffee|/beans", "coffee"),
    (r"\b(shop|store)\b|/shop|/store|/collections/all", "shop"),
]
LINK_RANK = {"coffee": 0, "menu": 1, "pdf": 2, "shop": 3}

# Shop software, on raw HTML.
PLATFORM_RULES = [
    (r"(?i)cdn\.shopify\.com|Shopify\.theme|shopify-section", "shopify"),
    (r'(?i)wp-content/plugins/woocommerce|woocommerce-page|class="[^"]*\bwoocommerce\b', "woocommerce"),
    (r"(?i)square\.site|squareup\.com|editmysite\.com|square-online", "square"),
]
STORE_PLATFORMS = ("shopify", "woocommerce")
