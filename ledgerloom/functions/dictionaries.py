"""Fixed values of the order data: word lists, spellings and rates that results depend on."""

from __future__ import annotations

# Money words and their amounts.
PRICE_WORDS = {
    "ألف": 1000,
    "الف": 1000,
    "ألفان": 2000,
    "الفان": 2000,
    "ألفين": 2000,
    "ألفان فقط": 2000,
    "خمسة آلاف": 5000,
    "خمسه الاف": 5000,
    "خمسة الاف": 5000,
    "عشرة آلاف": 10000,
    "عشره الاف": 10000,
}

# Spellings of cities.
CITIES = {
    "صنعا": "صنعاء",
    "صنعاء القديمة": "صنعاء",
    "الحديده": "الحديدة",
    "الحديده القديمة": "الحديدة",
    "عدن": "عدن",
    "تعز": "تعز",
    "أب": "إب",
    "اب": "إب",
    "مارب": "مأرب",
    "المكلا": "المكلا",
    "سيئون": "سيئون",
    "ذمار": "ذمار",
}

# Synonyms of order status, payment status, delivery type and payment method, in one map.
SYNONYMS = {
    "مؤكد": "مؤكد",
    "مؤكدة": "مؤكد",
    "تم التأكيد": "مؤكد",
    "confirmed": "مؤكد",
    "confirm": "مؤكد",
    "جديد": "جديد",
    "طلب جديد": "جديد",
    "new": "جديد",
    "قيد التنفيذ": "قيد التنفيذ",
    "تم الشحن": "قيد الشحن",
    "قيد الشحن": "قيد الشحن",
    "shipped": "قيد الشحن",
    "shipping": "قيد الشحن",
    "تم التسليم": "تم التسليم",
    "delivered": "تم التسليم",
    "مكتمل": "تم التسليم",
    "complete": "تم التسليم",
    "completed": "تم التسليم",
    "ملغي": "ملغي",
    "كنسل": "ملغي",
    "canceled": "ملغي",
    "cancelled": "ملغي",
    "مرتجع": "مرتجع",
    "returned": "مرتجع",
    "راجع": "مرتجع",
    "رجع": "مرتجع",
    "مدفوع": "مدفوع",
    "تم الدفع": "تم الدفع",
    "خالص": "تم الدفع",
    "paid": "تم الدفع",
    "معلق": "معلق",
    "قيد الانتظار": "معلق",
    "pending": "معلق",
    "مرفوض": "مرفوض",
    "rejected": "مرفوض",
    "failed": "مرفوض",
    "بانتظار الدفع": "بانتظار الدفع",
    "unpaid": "بانتظار الدفع",
    "غير مدفوع": "بانتظار الدفع",
    "عادي": "عادي",
    "normal": "عادي",
    "standard": "عادي",
    "سريع": "سريع",
    "fast": "سريع",
    "express": "سريع",
    "فوري": "فوري",
    "instant": "فوري",
    "immediate": "فوري",
    "cash": "نقدًا عند التسليم",
    "cod": "نقدًا عند التسليم",
    "نقدا": "نقدًا عند التسليم",
    "كاش": "نقدًا عند التسليم",
    "نقد": "نقدًا عند التسليم",
    "الدفع عند الاستلام": "نقدًا عند التسليم",
    "card": "بطاقة",
    "credit": "بطاقة",
    "فيزا": "بطاقة",
    "مدى": "بطاقة",
    "wallet": "محفظة إلكترونية",
    "محفظه": "محفظة إلكترونية",
    "محفظة": "محفظة إلكترونية",
    "كريمي": "محفظة إلكترونية",
    "جيب": "محفظة إلكترونية",
}

DELIVERED = "تم التسليم"
PAID = "تم الدفع"

# Currencies and how many rials they are.
RATES = {"usd": 530, "$": 530, "dollar": 530, "دولار": 530, "sar": 140, "سعودي": 140, "ريال سعودي": 140, "سعوديه": 140}
RIALS = ("yer", "ريال", "ريال يمني", "لاير", "لاير يمني", "يمني")

# Mistyped e-mail domains.
DOMAINS = {
    "gmail.co": "gmail.com",
    "gamil.com": "gmail.com",
    "gml.com": "gmail.com",
    "gmail.com.": "gmail.com",
    "gmail.co.com": "gmail.com",
    "g-mail.com": "gmail.com",
    "yahoo.co": "yahoo.com",
    "yaho.com": "yahoo.com",
    "yahooo.com": "yahoo.com",
    "outlook.co": "outlook.com",
    "outlok.com": "outlook.com",
    "hotmail.co": "hotmail.com",
    "hotmial.com": "hotmail.com",
}

# Names of currencies before and after an amount.
BEFORE_AMOUNT = ("USD", "SAR", "YER", "$")
AFTER_AMOUNT = ("ريال يمني", "ريال", "لاير يمني", "لاير", "YER", "USD", "SAR", "$")

# Titles before a name: Arabic words (some with a stroke behind), letters and English abbreviations with a full stop.
TITLE_WORDS = ("السيد", "السيده", "الدكتور", "الدكتوره", "المهندس", "المهندسه", "الاستاذ", "الاستاذه", "الشيخ", "الشيخه")
TITLE_LETTERS = ("أ.", "د.", "م.")
STROKED_TITLES = ("السيد", "المهندس")
TITLE_ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Eng.", "Prof.")
