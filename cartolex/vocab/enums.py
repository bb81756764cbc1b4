"""Closed vocabularies. Ids and labels that stored rows contain."""

ROAST_LEVELS = {
    "light": "Light",
    "medium-light": "Medium-light",
    "medium": "Medium",
    "medium-dark": "Medium-dark",
    "dark": "Dark",
    "omni": "Omni",
}
PROCESSES = {
    "washed": "Washed",
    "natural": "Natural",
    "honey": "Honey",
    "anaerobic": "Anaerobic",
    "carbonic-maceration": "Carbonic maceration",
    "wet-hulled": "Wet-hulled",
    "other": "Other / experimental",
}
MENU_CATEGORIES = {
    "espresso": "Espresso",
    "brewed": "Brewed",
    "pour-over": "Pour-over",
    "cold": "Cold",
    "tea": "Tea",
    "food": "Food",
    "other": "Other",
}
KINDS = {"roaster": "Roaster", "cafe": "Café", "both": "Roaster + café"}
DATA_STATUSES = ("beans", "menu-only", "none")
PLATFORMS = ("shopify", "woocommerce", "square", "other", "unknown")
CRAWL_STATUSES = ("ok", "blocked-robots", "error", "no-site")
ITEM_SOURCES = ("shopify", "woocommerce", "keywords", "llm", "override")

FLAVOR_FAMILIES = {
    "fruity": "Fruity",
    "fruity/berry": "Berry",
    "fruity/dried-fruit": "Dried fruit",
    "fruity/other-fruit": "Other fruit",
    "fruity/citrus": "Citrus",
    "sour-fermented": "Sour / fermented",
    "green-vegetative": "Green / vegetative",
    "roasted": "Roasted",
    "spices": "Spices",
    "nutty-cocoa": "Nutty / cocoa",
    "nutty-cocoa/nutty": "Nutty",
    "nutty-cocoa/cocoa": "Cocoa",
    "sweet": "Sweet",
    "sweet/brown-sugar": "Brown sugar",
    "sweet/vanilla": "Vanilla",
    "floral": "Floral",
    "floral/tea": "Tea",
    "floral/floral": "Floral",
    "other": "Other",
}

# Limits of one published document.
MAX_ITEMS_PER_ENTITY = 200
MAX_MENU_PER_ENTITY = 150
MAX_NOTES_PER_ITEM = 8
ITEM_NAME_CHARS, MENU_NAME_CHARS, DESCRIPTION_CHARS = 120, 80, 4000
# Cuts of extraction responses: rows, characters by field, members of lists and their characters.
ITEM_LIMITS = {"rows": 250, "name": 120, "url": 500, "origin_text": 200, "region": 80, "farm": 80, "producer": 80, "process": 60, "roast": 30, "notes": 8, "members": 12, "chars": 60}
MENU_LIMITS = {"rows": 200, "name": 80, "description": 200}
MAX_DOCUMENT_BYTES = 900_000
ITEM_MISS_LIMIT = 2
DELETE_AFTER_RUNS = 4
FRESHNESS_DAYS = 21
NEAR_ME_KM = 50.0
CONTEXT_CHARS = 30_000
