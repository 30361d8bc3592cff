"""Classification by pattern: document types, supporting papers, product policy, chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types whose endings are not part of a name.
EXTENSIONS = "pdf png jpg jpeg webp tif tiff bmp docx doc xlsx xls csv txt".split()

# The ten document types and what their names look like.
DOCUMENT_TYPES = {
    "Cancelled Cheque": r"\bcheques?\b|\bchecks?\b|\bchq\b|\bcancel(?:led|ed)?\s*(?:cheq(?:ue)?|check)\b",
    "GST": r"\bgst(?:in|n)?\b|\bgoods\s+and\s+services\s+tax\b",
    "MD": r"(?<![a-z])md\s*[-_ ]*\s*\d{1,2}(?!\d)|\bmd\b(?!\s*[-_ ]*\d{3})|licen[cs]e\s*md\s*\d{1,2}(?!\d)|\bmdr\s+(?:licen[cs]e|registration)\b|\bmedical\s+device\s+licen[cs]e\b",
    "Udyam": r"\b(?:udyam|udhyam|udyog|udhyog|msme)\b|\budyamregistration\b",
    "ISO": r"\biso(?:\s*\d+(?!\d)|\b)|\b(?:9001|13485|14001|45001)\b",
    "PAN Card": r"\bpan\b|pan\s*card\b|\bpermanent\s+account\s+number\b",
    "Form 16": r"\bform\s*[-_ ]*16\b(?!\s*a\b)",
    "Aadhar": r"\b(?:aadhar|aadhaar|adhaar|aad har|adhar)\b|(?:aadhar|aadhaar|adhaar|adhar)\s*card\b",
    "Price": r"\b(?:price|pricing|pricelist|price\s*list|rate\s*list|rate\s*card)\b",
    "Catalogue": r"\b(?:catalogue|catalog|product\s+catalog(?:ue)?)\b",
}

# Words of papers that support a file but do not prove any of the types above.
SUPPORTING_ONLY = (
    r"\b(?:incorporation|startup|company\s+registration|ce|fda|lut|challan|invoice|brochure|quotation)\b"
    r"|certificateofincorporation|\backnowledgement\b"
)

# Kinds of supporting papers, first match wins.
SUPPORTING_TYPES = {
    "Incorporation": r"incorporation|fillip.*approval|company[ _-]*registration|\bmca\b|coi$",
    "IEC": r"\biec\b|import.*export.*code",
    "CE": r"\bce\b",
    "FDA": r"\bfda\b",
    "Trademark": r"trade[ _-]*mark",
    "Bank details": r"\bbank\b.*(?:detail|letter|certificate)",
    "Brochure": r"brochure|catalogue|catalog",
    "Invoice / challan": r"invoice|challan",
    "Factory licence": r"factory.*licen[cs]e",
    "Drug / regulatory licence": r"\bcdsco\b|drug.*licen[cs]e|\bslr\b|\bclr\b",
    "Startup registration": r"start+up|dpiit",
    "Quality certificate": r"quality[ _-]*management|\bqms\b|\bgmp\b|\bbscic\b|dakks|\bnabl\b|iec\s*60601|\bqc\b",
    "Compliance certificate": r"compli[ae]nce|complience",
    "Other registration": r"registration|\bnsic\b|\bvat\b|\bdic\b|shop[ _-]*act|enlistment",
    "LUT acknowledgement": r"\blut\b",
    "Passport": r"passport",
    "Marketplace certificate": r"india[ _-]*mart",
    "EC certificate": r"\bec\b.*certif",
}

# Vocabulary of medicines, of devices named like medicines, and of medical goods.
MEDICINE = (
    r"pharmaceuticals?|medicines?|medications?|drugs?|antibiotics?|antivirals?|antifungals?|analgesics?|painkillers?|vaccines?|insulin|paracetamol|"
    r"acetaminophen|amoxicillin|azithromycin|ibuprofen|metformin|atorvastatin|omeprazole|cetirizine|doxycycline|ciprofloxacin|"
    r"dosage\s+form|tablets?|capsules?|syrups?|elixirs?|suppositories|injectables?|ophthalmic\s+drops|eye\s+drops|ear\s+drops|oral\s+drops"
)
DEVICE = (
    r"tablet\s+(?:press|counter|counting)|capsule\s+(?:filling|polishing)\s+machine|pill\s+cutter|syringe\s+pump|infusion\s+pump|"
    r"injection\s+mould|injection\s+molding|vaccine\s+refrigerator"
)
MEDICAL = (
    r"medical|healthcare|health\s+care|hospital|clinical|surgical|surgery|diagnostic|diagnostics|laboratory|laboratories|pathology|radiology|"
    r"dental|dentistry|ophthalmic|optical|patient\s+care|medical\s+device|ventilator|defibrillator|electrocardiograph|ecg|ekg|patient\s+monitor|"
    r"pulse\s+oximeter|oximeter|ultrasound|ultrasonic\s+scanner|x[\s-]?ray|mri|ct\s+scanner|endoscope|endoscopy|laparoscope|anesthesia|anaesthesia|"
    r"centrifuge|microscope|spectrophotometer|autoclave|sterili[sz]er|incubator|dialysis|hemodialysis|haemodialysis|electrosurgical|"
    r"infusion\s+pump|syringe\s+pump|surgical\s+instrument|forceps|scalpel|catheter|cannula|stethoscope|thermometer|sphygmomanometer|"
    r"blood\s+pressure\s+monitor|glucometer|glucose\s+meter|blood\s+glucose\s+test|test\s+strip|specimen|vacutainer|"
    r"blood\s+collection|clot\s+activator\s+vials?|urine\s+containers?|test\s+tubes?|culture\s+media|vacuum\s+(?:esr|pt)\b|"
    r"petri\s+dish|pipette|micropipette|reagent|assay|pcr\s+(?:kit|test)|rapid\s+test|diagnostic\s+kit|laboratory\s+kit|lab\s+(?:kit|equipment|consumable)|"
    r"examination\s+gloves?|surgical\s+gloves?|medical\s+gloves?|latex\s+gloves?|nitrile\s+gloves?|surgical\s+masks?|medical\s+masks?|face\s+masks?|"
    r"personal\s+protective\s+equipment|ppe|surgical\s+gown|isolation\s+gown|gauze|dressing|bandage|wound\s+care|suture|sutures|surgical\s+thread|"
    r"hypodermic\s+needle|disposable\s+needle|medical\s+syringe|iv\s+set|infusion\s+set|blood\s+transfusion\s+set|"
    r"wheelchair|hospital\s+bed|patient\s+bed|examination\s+table|mobility\s+aid|orthopedic|orthopaedic|prosthe[st]is|implant|sterile\s+gloves|"
    r"medical\s+disposable|clinical\s+consumable|surgical\s+consumable|sterile\s+(?:drapes?|dressings?|gloves?|syringes?|needles?|tubing)|"
    r"urine\s+analy[sz]er|hematology\s+analy[sz]er|haematology\s+analy[sz]er|biochemistry\s+analy[sz]er|clinical\s+chemistry\s+analy[sz]er|"
    r"blood\s+bank|blood\s+bag|medical\s+refrigerator|vaccine\s+refrigerator"
)

# Fixed value: a whole price, with an optional rupee mark and grouped or plain digits.
PRICE = r"(?i)^\s*(?:(?:₹|INR)\s*)?\+?((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)\s*(?:INR)?\s*$"

# How a chat line starts and what a price in it looks like.
CHAT_START = r"(?i)^\[?(\d{1,4}[/-]\d{1,2}[/-]\d{2,4},?\s+\d{1,2}:\d{2}(?:\s*[ap]m)?)\]?\s*[-,]?\s*"
CHAT_PRICE = (
    r"(?i)(?:₹|INR|Rs\.?)\s*([\d,]+(?:\.\d+)?)"
    r"|([\d,]+(?:\.\d+)?)\s*(?:INR\b|Rs\.?|₹)"
    r"|\b(?:price|rate)\s*(?:is|:|-)?\s*(?:₹|INR|Rs\.?)?\s*([\d,]+(?:\.\d+)?)"
)


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iU){pattern}")


def file_stem(path: Column) -> Column:
    """The last part of a path without its known endings, underscores as spaces, lower case."""
    name = F.regexp_extract(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"[^/]*$", 0)
    return F.lower(F.replace(F.regexp_replace(name, rf"(?i)(?:\.(?:{'|'.join(EXTENSIONS)}))+$", ""), F.lit("_"), F.lit(" ")))


def document_types(path: Column) -> Column:
    """Types that a file name proves; supporting papers prove none but a named ISO, and a business's Udyog Aadhaar is no personal one."""
    text = file_stem(path)
    found = F.array_compact(F.array(*[F.when(_has(text, p), F.lit(t)) for t, p in DOCUMENT_TYPES.items()]))
    own = F.when(F.array_contains(found, "Udyam"), F.array_remove(found, "Aadhar")).otherwise(found)
    supporting = F.when(F.array_contains(found, "ISO"), F.array(F.lit("ISO"))).otherwise(F.array().cast("array<string>"))
    return F.when(_has(text, SUPPORTING_ONLY), supporting).otherwise(own)


def supporting_category(path: Column) -> Column:
    """The first kind of supporting paper that a file name shows, else empty."""
    text = file_stem(path)
    return F.coalesce(*[F.when(_has(text, p), F.lit(t)) for t, p in SUPPORTING_TYPES.items()], F.lit(""))


def whole_price(c: Column) -> Column:
    """The number of a text that is one price and nothing else, else null."""
    return F.regexp_replace(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), PRICE, 1), F.lit("")), ",", "").cast("double")


def product_policy(name: Column, about: list[Column], record_type: Column, price: Column, numbers: dict[str, tuple[Column, float]]) -> Column:
    """struct(status, reason): approved, review or excluded; the first rule that speaks decides.

    ``about`` are other texts that describe the product, ``numbers`` further
    amounts (text) by label with the largest value allowed.  Null texts are empty.
    """
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, *about)])
    device = _has(text, rf"\b(?:{DEVICE})\b")
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    amount = whole_price(price)
    rule = (
        F.when((F.length(F.trim(F.coalesce(name, F.lit("")))) < 2) | ~name.rlike(r"\p{L}"), say("review", "no usable product name"))
        .when(_has(text, rf"\b(?:{MEDICINE})\b") & ~device, say("excluded", "medicine or pharmaceutical product"))
        .when(~empty(price) & (amount.isNull() | (amount < 0.01)), say("review", "price is not a single positive amount"))
        .when(empty(price) & (F.lower(record_type) == "price"), say("review", "price record without a price"))
    )
    for label, (value, most) in numbers.items():
        v = F.trim(value).try_cast("double")
        rule = rule.when(~empty(value) & (v.isNull() | F.isnan(v) | (v < 0) | (v > most)), say("review", f"{label} is out of range or no number"))
    return rule.when(~device & ~_has(text, rf"\b(?:{MEDICAL})\b"), say("review", "not confirmed as a medical product")).otherwise(say("approved", "validated medical product"))


def chat_offer(line: Column) -> Column:
    """struct(kind, sent, sender, product, price, currency) of a chat line.

    ``kind``: ``offer`` with exactly one price and a product, ``unclear`` with
    several prices or without a product, null for other lines.
    """
    text = F.trim(F.coalesce(line, F.lit("")))
    sent = F.regexp_extract(text, CHAT_START, 1)
    body = F.regexp_replace(text, CHAT_START, "")
    has_sender = body.contains(":")
    sender = F.when(has_sender, F.trim(F.substring_index(body, ":", 1))).otherwise("")
    message = F.when(has_sender, F.trim(F.substring(body, F.locate(":", body) + 1, F.length(body)))).otherwise(F.trim(body))
    n = F.regexp_count(message, F.lit(CHAT_PRICE))
    raw = F.coalesce(*[F.nullif(F.regexp_extract(message, CHAT_PRICE, g), F.lit("")) for g in (1, 2, 3)])
    marks = r"^[ \t,:;.-]+|[ \t,:;.-]+$"
    rest = F.regexp_replace(F.regexp_replace(message, CHAT_PRICE, " "), marks, "")
    product = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"(?i)\b(?:price|rate|is|for)\b", " "), r"\s+", " "), marks, "")
    named = (F.length(product) >= 2) & product.rlike(r"\p{L}")
    kind = F.when((sent == "") | (n == 0), F.lit(None).cast("string")).when((n == 1) & named, "offer").otherwise("unclear")
    return F.struct(
        kind.alias("kind"), sent.alias("sent"), sender.alias("sender"), product.alias("product"),
        F.regexp_replace(raw, ",", "").try_cast("double").alias("price"), F.when(message.rlike(r"(?i)₹|\bINR\b|\bRs\.?"), "INR").otherwise("").alias("currency"),
    )


def quote(unit_price: Column, quantity: Column, discount: Column, tax: Column, delivery: Column | None = None) -> Column:
    """struct of a quotation's amounts, each rounded to cents on its own; delivery is taxed with the goods."""
    subtotal = unit_price * quantity
    taxable = subtotal - subtotal * discount + (F.lit(0) if delivery is None else delivery)
    levy = taxable * F.greatest(F.lit(0), tax)
    cents = lambda c: F.round(c, 2)
    return F.struct(
        cents(subtotal).alias("subtotal"), cents(subtotal * discount).alias("discount_amount"), cents(taxable).alias("taxable_amount"),
        cents(levy).alias("tax_amount"), cents(levy / 2).alias("half_tax"), cents(taxable + levy).alias("final_amount"),
    )
