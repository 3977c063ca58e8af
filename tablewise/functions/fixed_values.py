"""Names, words and patterns that must equal the expected behaviour for right results."""

# Column names that suggest a prediction target.
TARGET_NAME_PATTERNS = [
    r"^target$", r"^label$", r"^class$", r"^y$", r"^output$",
    r"^survived$", r"^survival$", r"^outcome$", r"^result$",
    r"^price$", r"^salary$", r"^income$", r"^revenue$",
    r"^churn$", r"^fraud$", r"^default$", r"^diagnosis$",
    r"^species$", r"^category$", r"^type$", r"^grade$",
    r"^status$", r"^risk$", r"^prediction$", r"^response$",
    r"^sale", r"^cost", r"^amount", r"^value$",
    r"^rating$", r"^score$", r"^quality$",
]

# Statement words that suggest each problem type.
MULTILABEL_WORDS = ["multi-label", "multilabel", "multi label", "tagging", "tags", "multiple labels"]
CLASSIFICATION_WORDS = [
    "classify", "classification", "predict class", "predict category",
    "detect", "whether", "yes or no", "true or false",
    "spam", "fraud", "churn", "survive", "diagnose", "disease",
    "positive or negative", "pass or fail", "win or lose",
    "binary", "multiclass", "multi-class", "categorize",
    "is it", "will it", "does it", "can it",
]
REGRESSION_WORDS = [
    "regression", "predict price", "predict value", "predict amount",
    "how much", "how many", "forecast", "estimate",
    "continuous", "numeric prediction", "predict salary",
    "predict cost", "predict revenue", "predict score",
    "predict rating", "quantity", "predict number",
]

# Semantic type hints.
ID_NAMES = ["id", "index", "row_id", "record_id", "serial", "uuid", "key"]
BOOLEAN_SETS = [{"0", "1"}, {"yes", "no"}, {"true", "false"}, {"y", "n"}, {"t", "f"}, {"male", "female"}, {"m", "f"}]
ORDINAL_NAMES = ["rating", "rank", "level", "grade", "priority", "severity", "satisfaction", "experience", "quality"]
ORDINAL_VALUES = ["low", "medium", "high", "very high", "very low", "poor", "fair", "good", "excellent"]
CYCLIC_NAMES = ["month", "day_of_week", "dayofweek", "hour", "minute", "weekday", "quarter", "season"]
DATE_TEXT = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
CURRENCY_TEXT = r"^[\$€£₹¥]\s?[\d,]+\.?\d*$"
PERCENT_TEXT = r"^[\d.]+\s?%$"
GEO_NAMES = ["latitude", "longitude", "lat", "lon", "lng", "long"]

# Words that mean yes and no.
TRUE_WORDS = ["yes", "y", "true", "t", "1", "on", "si", "oui", "ja", "da"]
FALSE_WORDS = ["no", "n", "false", "f", "0", "off", "non", "nein", "nyet"]

# Placeholder numbers that stand for a missing value.
SENTINELS = [-1, -99, -999, -9999, 99, 999, 9999, 99999, 999999, 0]

# Ordered vocabularies; a column whose values are a subset of one becomes its 1-based rank.
ORDERED_WORDS = [
    ["low", "medium", "high"],
    ["small", "medium", "large"],
    ["small", "medium", "large", "xlarge"],
    ["poor", "fair", "good", "excellent"],
    ["never", "rarely", "sometimes", "often", "always"],
    ["very low", "low", "medium", "high", "very high"],
    ["beginner", "intermediate", "advanced", "expert"],
]

# Patterns of the column coercions.
CURRENCY_VALUE = r"^[\s]*[$€£¥₹₩₽₿]?\s*-?\s*[\d,]+\.?\d*\s*$|^[\s]*-?\s*[\d.]+,\d{2}\s*[€£]?\s*$"
CURRENCY_SYMBOLS = r"[$€£¥₹₩₽₿\s]"
EU_NUMBER = r"^-?[\d.]+,\d{2}$"
PERCENT_VALUE = r"^\s*-?\d+\.?\d*\s*%\s*$"
MARKUP_TAG = r"<[^>]+>"
BASE64_TEXT = r"^[A-Za-z0-9+/=]+$"
EMAIL_VALUE = r"^[\w.+-]+@[\w-]+\.[\w.]+$"
PHONE_VALUE = r"^[\+]?[\d\s\-\(\)]{7,15}$"
URL_VALUE = r"(?i)^https?://|^www\."
ID_COLUMN_NAME = r"(?i)(^id$|_id$|^uuid|^guid|^key$|^index$|^row_?num)"

# Kinds of personal data: (kind, pattern, column name hints, risk).
PERSONAL_KINDS = [
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", ["email", "e_mail", "mail", "email_address"], "high"),
    ("phone", r"(\+?\d{1,3}[\-.\s]?)?\(?\d{3}\)?[\-.\s]?\d{3}[\-.\s]?\d{4}",
     ["phone", "telephone", "mobile", "cell", "tel", "phone_number"], "high"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", ["ssn", "social_security", "social_security_number"], "critical"),
    ("credit_card", r"\b\d{4}[\-\s]?\d{4}[\-\s]?\d{4}[\-\s]?\d{4}\b", ["credit_card", "card_number", "cc_number", "card_no"], "critical"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", ["ip", "ip_address", "ipv4", "client_ip", "server_ip"], "medium"),
    ("aadhaar", r"\b\d{4}\s?\d{4}\s?\d{4}\b", ["aadhaar", "aadhar", "uid"], "critical"),
    ("passport", r"\b[A-Z]{1,2}\d{6,8}\b", ["passport", "passport_number", "passport_no"], "critical"),
    ("date_of_birth", r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", ["dob", "date_of_birth", "birth_date", "birthdate", "birthday"], "medium"),
    ("name", None, [
        "name", "first_name", "last_name", "full_name", "firstname", "lastname", "surname", "given_name",
        "family_name", "patient_name", "customer_name", "employee_name", "user_name", "username"], "high"),
    ("address", None, ["address", "street", "street_address", "home_address", "mailing_address", "addr", "postal_address"], "high"),
    ("zipcode", r"\b\d{5}(-\d{4})?\b", ["zip", "zipcode", "zip_code", "postal_code", "pincode", "pin_code"], "low"),
]

# Sentiment words.
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic",
    "love", "best", "perfect", "awesome", "happy", "beautiful",
    "outstanding", "brilliant", "impressive", "superb", "nice",
    "like", "enjoy", "recommend", "pleased", "satisfied", "positive",
    "helpful", "incredible", "remarkable", "delightful", "fabulous",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "horrible", "awful", "worst", "poor", "hate",
    "disappointing", "disappointed", "negative", "ugly", "boring",
    "waste", "useless", "pathetic", "annoying", "frustrating",
    "broken", "failed", "failure", "problem", "issue", "complaint",
    "unfortunately", "regret", "dreadful", "unpleasant",
]

# Words in a statement that suggest a time series.
SERIES_WORDS = [
    "forecast", "time series", "timeseries", "temporal", "predict future",
    "trend", "seasonality", "date", "monthly", "daily", "weekly",
    "yearly", "quarterly", "hourly", "stock price", "sales forecast",
    "demand", "time-series",
]

# Column names that suggest a protected attribute.
SENSITIVE_NAMES = {
    "gender": r"(?i)(gender|sex|male|female)",
    "race": r"(?i)(race|ethnicity|ethnic|color)",
    "age": r"(?i)(^age$|age_group|age_range)",
    "religion": r"(?i)(religion|faith|religious)",
    "nationality": r"(?i)(nationality|country|nation|citizen)",
    "disability": r"(?i)(disability|disabled|handicap)",
    "marital": r"(?i)(marital|married|spouse|marriage)",
}
