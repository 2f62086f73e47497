"""Word lists, character maps and patterns that results depend on."""

# Characters of broken PDF fonts, look-alike letters, spellings and signs, as source -> target.
GLYPHS = {
    "Ƭ": "ب", "ƪ": "ب", "ǭ": "ی", "Ǳ": "ی", "ǯ": "ی", "ǽ": "ی",
    "Ʈ": "پ", "ư": "پ", "Ǘ": "ن", "Ƴ": "ت", "Ʊ": "ت",
}
LETTERS = {
    "ي": "ی", "ى": "ی", "ئ": "ی", "ك": "ک", "ڪ": "ک", "ة": "ه",
    "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ؤ": "و", "ۀ": "ه",
    "\u200c": " ", "\u00a0": " ", "\u0640": "", "\u200b": "", "\u200d": "", "\ufeff": "",
}
MARKS = "[\u064b-\u0655\u0670\u06d6-\u06ed]"
SPELLINGS = {"باطری": "باتری"}
DASHES, SLASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u06d4", "\u2044\u2215"
PERSIAN = "[\u0600-\u06ff]"

# Unit words by quantity, and model-code words that are none.
UNITS = {"watt": ["وات", "w"], "amp": ["امپر", "امر"], "volt": ["ولت", "v"], "density": ["تراکم"], "degree": ["درجه"], "ip": ["ip"]}
MILLIMETRES = ["میلی\\s*متر", "میلیمتر", "mm"]
CENTIMETRES = ["سانتی\\s*متر", "سانتیمتر", "سانتی", "سانت", "cm"]
NOT_CODES = [
    "SMD", "COB", "DOB", "LED", "IP", "IP20", "IP44", "IP65", "IP66", "IP64", "RGB", "PVC", "AC", "DC", "PRO", "BASIC", "NEW", "K", "W", "V", "A",
    "CM", "MM", "KA", "PIR", "E27", "E14", "MR16", "GU10", "RCBO", "RCCB", "MCB",
]

# Wordings that mean the same, wordings implied by others, words that mark a variant, brands and their
# code prefixes.
SYNONYMS = {
    "تکفاز": "تک پل", "دوفاز": "دو پل", "سهفاز": "سه پل", "چهارفاز": "چهار پل", "تک فاز": "تک پل", "دو فاز": "دو پل", "سه فاز": "سه پل", "چهار فاز": "چهار پل",
    "سنسور دار": "سنسوردار", "وایرلس": "بدون سیم", "نقره ای پلاس": "سیلور پلاس", "رابط": "درایور", "چراغ خطی": "براکت", "فنر متغییر": "فنر متحرک",
    "فنر متغیر": "فنر متحرک", "اپلاست": "ا پلاست", "ا پلاست": "اپلاست", "روکار": "رو کار", "توکار": "تو کار", "مینیاتوری": "مینیاتور",
    "پروژکتور": "پرولایت", "شلنگی": "بدون سیم",
}
CONTEXT_RULES = [
    {"when": ["محافظ جان", "تک فاز"], "add": ["دو پل"]},
    {"when": ["محافظ جان", "سه فاز"], "add": ["چهار پل"]},
    {"when": ["محافظ جان", "ترکیبی"], "add": ["rcbo", "ترکیبی دو پل"]},
    {"when": ["چراغ خطی"], "add": ["براکت فول لایت"]},
    {"when": ["ریسه", "شلنگی"], "add": ["ریسه روشنایی بدون سیم"]},
]
DISCRIMINATORS = [
    "سنسوردار", "اضطراری", "نسوز", "ترکیبی", "متحرک", "دیواری", "rgb", "ip64", "ip66", "اسلیم لاین", "واید لاین", "سیلور پلاس", "درایور", "کانکتور",
    "منبع تغذیه", "ریموت", "محافظ جان", "مینیاتوری", "چسب برق",
]
BRAND_PREFIXES = {"شیله": ["SC"], "schiele": ["SC"], "ویسنا": ["VS"], "visena": ["VS"]}

# Words of column headings and of notes in price lists.
HEADING_WORDS = [
    "مدل", "قیمت", "تومان", "تعداد در کارتن", "تعداد در بسته", "توان", "رنگ نور", "رنگ بدنه", "سایز بیرونی", "سایز برش", "فرم بدنه", "توضیحات", "نوع قطعه",
    "نوع درایور", "نوع سنسور", "نوع چراغ", "نوع منبع تغذیه", "سری ریسه", "متراژ در کارتن", "قدرت قطع اتصال کوتاه", "جریان نشتی", "زاویه پوشش", "ارتفاع نصب",
    "محدوده آشکار سازی", "درجه حفاظتی", "تراکم", "زاویه پرتاب نور", "سایز چسب",
]
NOTES = "(?i)(pricelist|page\\s*no|بازگشت به فهرست|لیست قیمت|شماره صفحه|flicker|body material|heat sink|driver|new product)"
WATT_HEADING, WATT_UNIT = "توان", "وات"

# Labels of sheet columns by field, units by name, and labels of results.
HEADERS = {
    "code": ["code", "product code", "item code", "sku", "partnumber", "part number", "part no", "کد", "کد کالا", "کدکالا", "کد محصول", "کد فنی", "شناسه", "شناسه کالا", "کد انبار", "کد سیستم", "ردیف کد"],
    "name": ["name", "product name", "item name", "description", "product", "title", "نام", "نام کالا", "نام محصول", "شرح", "شرح کالا", "شرح محصول", "کالا", "عنوان", "عنوان کالا", "نام و مشخصات"],
    "brand": ["brand", "maker", "manufacturer", "vendor", "برند", "سازنده", "تولید کننده", "مارک"],
    "model": ["model", "type", "مدل", "تیپ", "نوع"],
    "unit": ["unit", "uom", "واحد", "واحد شمارش", "واحد سنجش"],
    "price": ["price", "unit price", "amount", "rate", "قیمت", "مبلغ", "فی", "قیمت واحد", "قیمت فروش", "بها", "نرخ", "قیمت ریال", "قیمت تومان"],
    "stock": ["stock", "inventory", "qty", "quantity", "on hand", "balance", "موجودی", "موجودی انبار", "تعداد", "مانده", "مقدار", "موجود"],
}
UNIT_NAMES = {
    "m": ["m", "metr", "meter", "متر", "مترطول", "متر طول"], "pcs": ["pcs", "pc", "piece", "عدد", "دستگاه", "قلم", "شاخه", "تعداد"],
    "box": ["box", "ctn", "carton", "جعبه", "کارتن", "بسته", "پک", "pack"], "roll": ["roll", "حلقه", "رول", "کلاف"], "kg": ["kg", "کیلو", "کیلوگرم"], "set": ["set", "ست", "سری"],
}
STATUS_LABELS = {"EXACT": "دقیق", "HIGH": "معتبر", "REVIEW": "نیاز به بررسی", "NOT_FOUND": "بدون قیمت"}
NOTE_CONFLICT = "مغایرت در مشخصات فنی (توان/آمپر/ولتاژ)"
NOTE_OTHER_BRAND = "برند این کالا با برند لیست قیمت وارد شده یکی نیست"
NOTE_NO_BRAND = "برند این کالا در لیست قیمت وجود ندارد"
NOTE_AMBIGUOUS = "چند ردیف مشابه در لیست قیمت"
