"""Canonical categories, and the words that mean them."""

from __future__ import annotations

# Fixed values.
CATEGORIES = ("Smartphone", "Laptop", "Audio", "Wearable", "Monitor", "Tablet", "Storage", "Camera", "Printer", "Accessories", "Networking")

# Words of a product's name that tell its category; the first list that has one decides.
NAME_RULES = (
    ("Audio", ("earbuds", "buds", "headphone", "headset", "speaker")),
    ("Wearable", ("watch", "smartwatch", "galaxy fit", "fitness band", "fitness tracker")),
    ("Storage", ("ssd", "hdd", "hard drive", "flash drive", "portable drive")),
    ("Laptop", ("laptop", "notebook", "macbook", "chromebook", "ultrabook")),
    ("Monitor", ("monitor", "display", "oled")),
    ("Camera", ("camera", "eos", "alpha", "mirrorless", "dslr")),
    ("Tablet", ("tablet", "ipad", "galaxy tab")),
    ("Smartphone", ("phone", "smartphone", "galaxy s", "galaxy a", "galaxy z", "iphone", "pixel")),
)

# Words of the category field, where the name tells nothing.
FIELD_RULES = (
    ("Audio", ("audio", "earbuds", "headphone")),
    ("Wearable", ("wearable", "watch")),
    ("Storage", ("storage",)),
    ("Monitor", ("monitor", "display")),
    ("Laptop", ("laptop", "computer")),
    ("Camera", ("camera",)),
    ("Tablet", ("tablet",)),
    ("Smartphone", ("mobile", "phone", "smartphone")),
)

# Query words that ask for a category.
INTENT = {
    "Smartphone": ("phone", "phones", "smartphone", "smartphones", "mobile", "mobiles"),
    "Audio": ("earbud", "earbuds", "bud", "buds", "earphone", "earphones", "headphone", "headphones", "headset", "headsets", "speaker", "speakers", "audio"),
    "Laptop": ("laptop", "laptops", "notebook", "notebooks", "macbook"),
    "Wearable": ("watch", "watches", "smartwatch", "smartwatches", "wearable", "wearables"),
    "Camera": ("camera", "cameras", "dslr", "mirrorless"),
    "Monitor": ("monitor", "monitors", "display", "displays"),
    "Storage": ("ssd", "hdd", "storage"),
    "Tablet": ("tablet", "tablets", "ipad"),
    "Accessories": ("keyboard", "keyboards", "mouse", "mice", "accessory", "accessories"),
    "Networking": ("router", "routers", "mesh", "networking"),
    "Printer": ("printer", "printers"),
}

# Synonyms of normalised categories.
SYNONYMS = {
    "smartphone": ("phone", "phones", "smartphones", "mobile", "mobiles"),
    "audio": ("earbud", "earbuds", "bud", "buds", "earphone", "earphones", "headphone", "headphones", "headset", "headsets", "speaker", "speakers"),
    "laptop": ("notebook", "notebooks", "macbook"),
    "wearable": ("watch", "watches", "smartwatch", "smartwatches", "wearables"),
    "camera": ("cameras", "dslr", "mirrorless"),
    "monitor": ("display", "displays"),
    "storage": ("ssd", "hdd"),
    "tablet": ("ipad",),
    "accessories": ("keyboard", "keyboards", "mouse", "mice", "accessory"),
    "networking": ("router", "routers", "mesh", "wifi"),
    "printer": ("printers",),
}

# Parts of a name that tell the brand, in order.
BRANDS = (
    (("samsung",), "Samsung"),
    (("apple", "macbook", "iphone", "ipad"), "Apple"),
    (("sony",), "Sony"),
    (("canon",), "Canon"),
    (("nikon",), "Nikon"),
    (("dell",), "Dell"),
    (("lenovo",), "Lenovo"),
    (("oneplus",), "OnePlus"),
    (("google", "pixel"), "Google"),
    (("asus",), "ASUS"),
    (("hp",), "HP"),
    (("xiaomi", "redmi"), "Xiaomi"),
    (("realme",), "Realme"),
    (("oppo",), "OPPO"),
    (("vivo",), "Vivo"),
    (("logitech",), "Logitech"),
    (("jbl",), "JBL"),
)
