"""Vocabulary, patterns and policies as plain values."""

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Type -> tier of a detected value.
TIERS = {
    "EMAIL": 2, "PHONE": 2, "AADHAAR": 2, "PAN": 2, "IFSC": 2, "GSTIN": 2, "UPI": 2, "CARD": 2, "IP": 3, "DOB": 3, "SECRET": 1, "PASSWORD": 1,
    "CREDIT_CARD": 1, "CVC": 1, "OTP": 1, "STREET_ADDRESS": 3, "CITY": 3, "STATE": 3, "POSTAL_CODE": 3, "BDAY": 3, "MRN": 2, "PERSON_NAME": 3, "ORGANIZATION": 3,
}
#: Types whose values are never released, and those that identify.
TIER1 = ("PASSWORD", "SECRET", "API_KEY", "TOKEN", "CREDIT_CARD", "CVC", "OTP")
TIER2 = ("EMAIL", "PHONE", "AADHAAR", "PAN", "IFSC", "GSTIN", "UPI", "MRN", "SSN", "FINANCIAL", "HEALTH", "NAME", "ADDRESS")
ALIASES = {"CARD": "CREDIT_CARD", "BDAY": "DOB", "NAME": "PERSON_NAME", "ADDRESS": "STREET_ADDRESS"}
TLDS = "com|org|net|edu|gov|mil|int|io|co|ai|app|dev|me|us|uk|ca|au|de|fr|jp|in|br|mx|nl|se|no|fi|dk|ch|at|be|ie|pt|es|it|pl|cz|hu|ro|bg|hr|sk|si|lt|lv|ee|lu|mt|cy|is|li|mc|sm|va|ad|fo|gl|pm|tf|gf|mq|gp|re|yt|bl|mf|sx|bq|cw|aw|ai|vg|ky|tc|bm|fk|gs|sh|pn|nr|tv|fm|mh|pw|ki|to|ws|nu|cc|tk|eu|cat|asia|tel|xxx|jobs|mobi|pro|name|aero|coop|museum|travel|post|geo|arpa|example|test|localhost|invalid|local|internal|onion|bit|eth|luxe|zil|crypto|nft|dao|web3|metaverse"
BANK_CODES = ("SBIN", "HDFC", "ICIC", "UTIB", "KKBK", "YESB", "INDB", "RATN", "BKID", "CNRB", "PUNB", "UBIN", "IOBA", "ABHY", "ANDH", "SYNB", "CORP", "VIJB", "MAHB", "BKDN", "SBHY", "SBTR", "SBMJ", "STBP", "KARB", "FDRL", "SBPD")
UPI_HANDLES = ("okhdfcbank", "oksbi", "okicici", "okaxis", "okkotak", "okyesbank", "paytm", "phonepe", "gpay", "amazonpay", "mobikwik", "freecharge", "icici", "hdfc", "sbi", "axis", "kotak", "yesbank", "indusind", "upi", "bhim", "barodapay", "pnb", "canara", "unionbank")
SAMPLE_CARDS = ("4000000000000002", "4242424242424242", "5555555555555555", "4111111111111111")
#: Patterns of detected values with ASCII word boundaries written \b; see functions.text.java(). Digits are [0-9], which means the same to Java's engine, to
#: Python's and to the twins' RE2.
PATTERNS = {
    "email": r"\b[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.(?:" + TLDS + r")\b",
    "phone_in_e164": r"\+91[\s-]?[6-9](?:[\s-]?[0-9]){9}",
    "phone_in_bare": r"\b[6-9][0-9]{9}\b",
    "phone_generic": r"\+[0-9]{1,3}\s?[0-9]{6,14}\b",
    "aadhaar": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "gstin": r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
    "upi": r"\b[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "ipv6_full": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "ipv6_compressed": r"(?<=^|[\s()\[\]{}<>,.;:!?])(?:(?:[0-9a-fA-F]{1,4}:){1,6}:(?:[0-9a-fA-F]{1,4}:)*+[0-9a-fA-F]{1,4}|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}::|::1)(?![:0-9a-fA-F])",
    "dob_iso": r"\b(?:19|20)[0-9]{2}[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12][0-9]|3[01])\b",
    "dob_us": r"\b(?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12][0-9]|3[01])[-/.](?:19|20)[0-9]{2}\b",
}
RESERVED_MAIL = r"@(example\.(com|org|net)|[^.]+\.(test|invalid|localhost)|localhost)$"
PHONE_CONTEXT = r"india|indian|\+91|phone|mobile|contact|tel"
CARD_CONTEXT = r"order|invoice|transaction|reference|ref\s*#|id\s*#|sku|serial|account\s*#"
DOB_CONTEXT = r"(dob|date.of.birth|birth.date|born|age|birthday)"
#: (label, type, value) rules of a value that stands beside a label; the first label that fits decides.
LABEL_RULES = (
    (r"^(full |customer |patient |account |your |contact )?name$", "PERSON_NAME", r"^[A-Za-z][A-Za-z.'\- ]{1,60}$"),
    (r"^(mobile|phone|telephone|contact number|mobile number|phone number)$", "PHONE", r"(?:[0-9][\s-]?){6,}"),
    (r"^(street|street address|address|address line ?1|residential address|shipping address|billing address|house|flat)$", "STREET_ADDRESS", r"^.{3,80}$"),
    (r"^(city|town|district|village)$", "CITY", r"^[A-Za-z][A-Za-z.\- ]{1,40}$"),
    (r"^(state|province|region)$", "STATE", r"^[A-Za-z][A-Za-z.\- ]{1,40}$"),
    (r"^(pin|pin ?code|pincode|postal ?code|postcode|zip|zip ?code)$", "POSTAL_CODE", r"^[1-9][0-9]{5}$|^[0-9]{5}(-[0-9]{4})?$"),
    (r"^(dob|date of birth|birth ?date|born)$", "DOB", r"[0-9]"),
    (r"^(aadhaar|aadhar|uid|uidai)( number| no\.?)?$", "AADHAAR", r"^[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}$"),
    (r"^(pan|pan number|pan card)$", "PAN", r"(?i)^[A-Z]{5}[0-9]{4}[A-Z]$"),
    (r"^(mrn|medical record|patient id|record number)$", "MRN", r"(?i)^[A-Z0-9-]{4,}$"),
    (r"^(e-?mail|e-?mail address)$", "EMAIL", r"@"),
)
NOT_A_VALUE = r"(?i)^(delivered|shipped|processing|pending|cancelled|canceled|active|inactive|none|n/a|unknown|yes|no|true|false|required|optional|verified|unverified|paid|unpaid|confirmed)$"
INLINE = r"^([A-Za-z][A-Za-z .-]{1,30}?)\s*[:：]\s*(.+)$"
#: (tokens, type, confidence, rule) of a form field's autocomplete attribute.
AUTOCOMPLETE = (
    (("cc-number", "credit-card", "card-number"), "CREDIT_CARD", 0.99, "element-autocomplete-cc-number-v1"),
    (("cc-csc", "cc-cvc", "cvc", "cvv", "security-code"), "CVC", 0.99, "element-autocomplete-cvc-v1"),
    (("cc-exp", "cc-exp-month", "cc-exp-year", "cc-name", "cc-type"), "CREDIT_CARD", 0.9, "element-autocomplete-cc-meta-v1"),
    (("one-time-code", "otp", "verification-code", "auth-code"), "OTP", 0.99, "element-autocomplete-otp-v1"),
    (("street-address", "address-line1", "address-line2", "address-line3"), "STREET_ADDRESS", 0.95, "element-autocomplete-street-v1"),
    (("postal-code", "postcode", "zip", "zip-code"), "POSTAL_CODE", 0.95, "element-autocomplete-postal-v1"),
    (("address-level2",), "CITY", 0.95, "element-autocomplete-city-v1"),
    (("address-level1",), "STATE", 0.95, "element-autocomplete-state-v1"),
    (("bday", "bday-day", "bday-month", "bday-year", "dob", "date-of-birth"), "BDAY", 0.95, "element-autocomplete-bday-v1"),
    (("email",), "EMAIL", 0.95, "element-autocomplete-email-v1"),
    (("tel", "tel-national", "tel-country-code", "tel-area-code", "tel-local", "tel-extension"), "PHONE", 0.9, "element-autocomplete-tel-v1"),
    (("name", "given-name", "additional-name", "family-name", "username", "nickname"), "PERSON_NAME", 0.8, "element-autocomplete-name-v1"),
    (("organization", "company"), "ORGANIZATION", 0.8, "element-autocomplete-org-v1"),
    (("address", "shipping", "billing"), "STREET_ADDRESS", 0.7, "element-autocomplete-address-v1"),
)
OTP_PATTERNS = (r"\botp\b|one.time|verification.code|auth.code|security.code|\bmpin\b|login pin|transaction pin", r"enter.*code|code.*sent|verify.*code", r"^[0-9]{4,6}$")
CARD_FIELD, CVC_FIELD = r"card.number|credit.card|card\b|cc\b", r"cvc|cvv|security.code|card.security"
#: (label, type, confidence, rule) of a form field without autocomplete; the first that fits decides.
FIELD_LABELS = (
    (r"aadhaar|aadhar|\buid\b", "AADHAAR", 0.9, "element-label-aadhaar-v1"),
    (r"\bpan\b", "PAN", 0.9, "element-label-pan-v1"),
    (r"\bmrn\b|medical record|patient id", "MRN", 0.85, "element-label-mrn-v1"),
    (r"e-?mail", "EMAIL", 0.85, "element-label-email-v1"),
    (r"mobile|phone|telephone", "PHONE", 0.85, "element-label-phone-v1"),
    (r"date of birth|\bdob\b|birth ?date", "BDAY", 0.85, "element-label-dob-v1"),
    (r"pin ?code|pincode|postal|zip", "POSTAL_CODE", 0.8, "element-label-postal-v1"),
    (r"^city$|\bcity\b|town", "CITY", 0.8, "element-label-city-v1"),
    (r"^state$|\bstate\b|province", "STATE", 0.8, "element-label-state-v1"),
    (r"address|street|house", "STREET_ADDRESS", 0.8, "element-label-address-v1"),
    (r"full name|^name$|first name|last name|your name|applicant name", "PERSON_NAME", 0.75, "element-label-name-v1"),
    (r"\bifsc\b", "IFSC", 0.85, "element-label-ifsc-v1"),
    (r"\bgstin?\b", "GSTIN", 0.85, "element-label-gstin-v1"),
    (r"\bupi\b|vpa", "UPI", 0.85, "element-label-upi-v1"),
)
NO_LABEL_TYPES = ("hidden", "button", "submit", "reset", "checkbox", "radio", "file", "search")
#: Policy profiles.
PROFILES = {
    "STRICT": {"unexplained_prior": 0.8, "tokenize": 0.35, "mask": 0.5, "drop": 0.8, "T1": "VAULT_ONLY", "T2": "TOKENIZE", "T3": "TOKENIZE", "T4": "ANNOTATE", "T5": "TOKENIZE", "regex": 1.0, "ner": 0.9, "ocr": 0.8, "vision": 0.5, "deterministic": 1.0, "min_coverage": 0.98},
    "BALANCED": {"unexplained_prior": 0.4, "tokenize": 0.35, "mask": 0.5, "drop": 0.8, "T1": "VAULT_ONLY", "T2": "TOKENIZE", "T3": "GENERALIZE", "T4": "ANNOTATE", "T5": "TOKENIZE", "regex": 1.0, "ner": 0.9, "ocr": 0.8, "vision": 0.5, "deterministic": 1.0, "min_coverage": 0.9},
    "PERMISSIVE": {"unexplained_prior": 0.1, "tokenize": 0.6, "mask": 0.8, "drop": 0.95, "T1": "VAULT_ONLY", "T2": "TOKENIZE", "T3": "PASS", "T4": "ANNOTATE", "T5": "TOKENIZE", "regex": 1.0, "ner": 0.9, "ocr": 0.8, "vision": 0.5, "deterministic": 1.0, "min_coverage": 0.75},
}
#: Type of a value -> types of fields that it may be put into.
ACCEPTED = {
    "EMAIL": ("EMAIL", "USERNAME"), "PHONE": ("PHONE",), "AADHAAR": ("AADHAAR",), "PAN": ("PAN",), "IFSC": ("IFSC",), "GSTIN": ("GSTIN",), "UPI": ("UPI",),
    "CREDIT_CARD": ("CREDIT_CARD",), "CVC": ("CVC",), "OTP": ("OTP",), "PASSWORD": ("PASSWORD",), "SECRET": ("SECRET", "PASSWORD"), "PERSON_NAME": ("PERSON_NAME", "NAME"),
    "STREET_ADDRESS": ("STREET_ADDRESS", "ADDRESS"), "CITY": ("CITY", "STREET_ADDRESS", "ADDRESS"), "STATE": ("STATE", "STREET_ADDRESS", "ADDRESS"),
    "POSTAL_CODE": ("POSTAL_CODE",), "DOB": ("DOB",), "IP": ("IP",), "MRN": ("MRN",), "ORGANIZATION": ("ORGANIZATION",),
}
FREE_TEXT_ACCEPTS = ("PERSON_NAME", "NAME", "STREET_ADDRESS", "ADDRESS", "CITY", "STATE", "POSTAL_CODE", "ORGANIZATION", "PERSONAL")
#: Path segments that are identifiers.
ID_SEGMENTS = (r"^[0-9]+$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[A-Z]{2,6}[-_]?[A-Z0-9]{5,}$", r"^[A-Za-z]{1,4}[-_]?[0-9]{2,}[A-Za-z0-9]*$", r"^[A-Za-z0-9_-]{20,}$")
#: Letters and digits, eight or more, at least one digit: two tests instead of a look-ahead.
ID_MIXED = (r"^[A-Za-z0-9_-]{8,}$", r"[0-9]")
#: The permutation that Verhoeff's scheme applies once more for each place; its tables follow from it and from the dihedral group (see the end).
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
MAX_PAYLOAD_BYTES, RATE_WINDOW_MS, RATE_MAX_SENDS = 256_000, 60_000, 90
#: Pixels: around the viewport, the longest side of a screenshot and of a crop.
VIEW_MARGIN, LONG_SIDE, CROP_SIDE = 50, 640, 512
OPAQUE_TAGS = ("canvas", "img", "svg", "video", "object", "embed")
INTERACTIVE_TAGS = ("input", "textarea", "select", "button", "a")
#: Input types without a state of their own.
STATELESS_TYPES = ("hidden", "button", "submit", "reset", "image", "file", "range", "color")
#: Entity label of a model -> type; other labels are PERSONAL.
NER_TYPES = {"PER": "NAME", "PERSON": "NAME", "LOC": "ADDRESS", "GPE": "ADDRESS", "LOCATION": "ADDRESS", "FAC": "ADDRESS", "ORG": "PERSONAL", "ORGANIZATION": "PERSONAL", "MISC": "PERSONAL", "DATE": "PERSONAL", "TIME": "PERSONAL", "MONEY": "FINANCIAL"}
NER_THRESHOLDS = {"STRICT": 0.35, "BALANCED": 0.5, "PERMISSIVE": 0.7}
#: What an action's label says of its risk, what needs a user's word, and roles that a planner is shown.
PAYING, DELETING = "pay|purchase|buy now|place order|checkout|confirm order", "delete|remove account|unsubscribe"
CONFIRM = ("PAYMENT", "DELETE", "NAVIGATE_EXTERNAL")
PROMPT_ROLES = ("button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "listbox", "menuitem", "tab", "switch", "slider", "spinbutton")
#: Ends of paths in a payload that name things of the protocol, and those that may hold long opaque strings.
PROTOCOL_PATH = r"(?:^|\.)(tag|role|type|group|input_type|autocomplete|placeholder_raw|label_raw|kind|source|sensitivity_class|pii_type|origin_class|type_hint|policy_profile|reasoning)$"
OPAQUE_PATH = r"(^|\.)(data_base64|session_id|observation_id|id_hash)$"
#: Words of ordinary pages that are no secrets.
GENERIC_WORDS = "personal information details address shipping billing application service services portal review documents document profile record records account orders order cart checkout search products product home about contact support help login sign register submit next back continue confirm settings privacy terms policy name phone email code number date birth street saved form step page total price status view track tracking".split()
#: Further words that a model takes for people and places.
NER_STOP_WORDS = "patient patients list report lab clinic desk government india indian bench demo reset welcome thank you the and for your my of to in on city state pin".split()
#: Sources' weights of the ablations; a source that isn't named keeps its own.
ABLATIONS = {
    "A1": {"ner": 0, "ocr": 0, "vision": 0, "deterministic": 0}, "A2": {"regex": 0, "ocr": 0, "vision": 0, "deterministic": 0}, "A3": {"regex": 0, "ner": 0, "vision": 0, "deterministic": 0},
    "A4": {"regex": 0, "ner": 0, "ocr": 0, "deterministic": 0}, "A5": {"regex": 0, "ner": 0, "ocr": 0, "vision": 0}, "A6": {"deterministic": 0}, "A7": {}, "A8": {"vision": 0}, "A9": {"vision": 0, "deterministic": 0},
}
#: Timings of a step that the client spends itself.
LOCAL_TIMINGS = ("observe", "capture", "perceive", "sanitize", "redact", "gate", "validate", "execute")
SESSION_TTL_MS = 30 * 60 * 1000
ENTROPY_LENGTH, ENTROPY_BITS, GRAM, LEAST_SECRET = 24, 4.0, 8, 6
# -------------------------------------------------------------------------------------------------------------------


def _dihedral(a: int, b: int) -> int:
    """The product of two symmetries of a pentagon: 0 to 4 are its turns, 5 to 9 its mirrorings."""
    return (a - b if a >= 5 else a + b) % 5 + 5 * ((a >= 5) != (b >= 5))


#: Products of digits, and permutations by place, both row by row.
VERHOEFF_D = tuple(_dihedral(a, b) for a in range(10) for b in range(10))
_rows = [tuple(range(10))]
for _ in range(7):
    _rows.append(tuple(_rows[-1][n] for n in VERHOEFF_STEP))
VERHOEFF_P = tuple(n for row in _rows for n in row)
