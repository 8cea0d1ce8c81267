"""Text, phone, channel and fallback rules as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that ask for the same order again.
REORDER_PHRASES = [
    "kif dima", "comme d'habitude", "comme toujours", "same as usual", "same as before", "même commande", "relancer", "renouveler",
    "la même chose", "pareil", "habituelle", "comme la dernière fois", "bhal dima", "comme avant", "réapprovisionnement",
]
#: Names given to senders that are not known.
GENERIC_NAMES = ("Client WhatsApp", "Client Inconnu")
#: Parts of a media type that mean a voice message.
AUDIO_MARKS = ("audio", "ogg", "opus", "mpeg", "mp3", "wav", "m4a", "voice")
#: Audio media types and their file extensions, first match wins.
AUDIO_EXTENSIONS = [("audio/ogg", "ogg"), ("audio/mpeg", "mp3"), ("audio/mp4", "m4a"), ("audio/wav", "wav"), ("audio/x-wav", "wav"), ("audio/webm", "webm"), ("audio/aac", "aac")]


def blank(c: Column) -> Column:
    """Null or the empty string."""
    return c.isNull() | (c == "")


def filled(c: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(F.nullif(c, F.lit("")), *others)


def client_code(id_: Column) -> Column:
    """CL and the id in at least five digits; a longer id is kept whole."""
    text = id_.cast("string")
    return F.concat(F.lit("CL"), F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, "0")))


#: White space as the domain's rules see it: a trim and a split go by all of it.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@lru_cache
def _accents() -> tuple[str, str]:
    """Letters with accents and their base letters, by canonical decomposition, of all scripts; then all marks, which have
    no counterpart and so go."""
    pairs, marks = [], []
    for c in (*range(0xC0, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x110000)):  # without Hangul and surrogates
        if unicodedata.category(chr(c)) == "Mn":
            marks.append(chr(c))
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")
        if base != chr(c) and len(base) == 1:
            pairs.append((chr(c), base))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case, as names are looked up."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalized_name(name: Column) -> Column:
    """Lower case without accents, apostrophes and full stops, hyphens as spaces, trimmed; null gives ''.

    Letters and marks of all scripts go through one translate, so no Python runs. Hangul syllables, and some Indic vowel
    signs that fall apart into two letters, stay composed."""
    text = F.translate(F.lower(F.coalesce(name, F.lit(""))), *_accents())
    return trimmed(F.translate(F.translate(text, "'.", ""), "-", " "))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""))


def phone_in(text: Column) -> Column:
    """The first + with digits in a text, or null."""
    return F.regexp_substr(text, F.lit(r"\+\d+"))


def phone_tail(text: Column) -> Column:
    """A text from its first + on, the whole of it if there is none."""
    return F.when(F.instr(text, "+") > 0, F.substring(text, F.instr(text, "+"), F.length(text))).otherwise(text)


def international(phone: Column) -> Column:
    """A phone number with one + and neither spaces nor channel prefix."""
    return F.concat(F.lit("+"), F.regexp_replace(phone, r"whatsapp:|[+ ]", ""))


def channel_address(phone: Column) -> Column:
    """whatsapp:+number."""
    with_plus = F.when(phone.startswith("whatsapp:") | phone.startswith("+"), phone).otherwise(F.concat(F.lit("+"), phone))
    return F.when(with_plus.startswith("whatsapp:"), with_plus).otherwise(F.concat(F.lit("whatsapp:"), with_plus))


def media_kind(body: Column, n_media: Column, media_type: Column) -> Column:
    """The kind of a message: its first medium by type, or text, or unknown."""
    kind = F.lower(F.coalesce(media_type, F.lit("")))
    audio = F.lit(False)
    for mark in AUDIO_MARKS:
        audio = audio | kind.contains(mark)
    by_media = F.when(kind.contains("image"), "image").when(audio, "audio").when(kind.contains("pdf") | kind.contains("document"), "document").otherwise("file")
    return F.when(F.coalesce(n_media, F.lit(0)) > 0, by_media).when(~blank(F.trim(F.coalesce(body, F.lit("")))), "text").otherwise("unknown")


def audio_extension(media_type: Column) -> Column:
    kind, out = F.lower(F.coalesce(media_type, F.lit(""))), None
    for mark, extension in AUDIO_EXTENSIONS:
        out = F.when(kind.contains(mark), extension) if out is None else out.when(kind.contains(mark), extension)
    return out.otherwise("ogg")


def file_kind(path: Column) -> Column:
    """How an attachment is read, by its extension."""
    extension = F.regexp_extract(F.lower(path), r"(\.[^.]+)$", 1)
    return F.when(extension == ".pdf", "pdf").when(extension.isin(".jpg", ".jpeg", ".png", ".gif", ".webp"), "image").when(extension.isin(".txt", ".csv"), "text").otherwise("other")


def resolved_source(source: Column, subject: Column) -> Column:
    return filled(source, F.when(F.lower(F.coalesce(subject, F.lit(""))).contains("whatsapp"), F.lit("whatsapp")).otherwise("email"))


def asks_again(text: Column) -> Column:
    """Whether a text has one of the reorder phrases."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for phrase in REORDER_PHRASES:
        found = found | low.contains(phrase)
    return found


def routable(email: Column) -> Column:
    return F.coalesce(email.contains("@"), F.lit(False))


def generic_name(name: Column) -> Column:
    out = F.lit(False)
    for prefix in GENERIC_NAMES:
        out = out | F.coalesce(name.startswith(prefix), F.lit(False))
    return out


def shortened(text: Column, n: int = 20) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def human_size(size: Column) -> Column:
    """Bytes in the largest of B, KB, MB, GB and TB below 1024, with one decimal."""
    out, value = None, size.cast("double")
    for unit in ("B", "KB", "MB", "GB"):
        shown = F.format_string(f"%.1f {unit}", value)
        out = F.when(value < 1024, shown) if out is None else out.when(value < 1024, shown)
        value = value / 1024
    return out.otherwise(F.format_string("%.1f TB", value))


def time_ago(seconds: Column) -> Column:
    s = seconds.cast("long")
    whole = lambda n: F.floor(s / n).cast("string")
    return F.when(s < 60, F.lit("À l'instant")).when(s < 3600, F.concat(F.lit("Il y a "), whole(60), F.lit(" min"))).when(s < 86400, F.concat(F.lit("Il y a "), whole(3600), F.lit("h"))).otherwise(F.concat(F.lit("Il y a "), whole(86400), F.lit("j")))


def model_json(text: Column) -> Column:
    """The JSON inside of a fenced answer, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?(.*?)(?:```|$)", 1)
    return F.regexp_replace(F.when(F.trim(text).startswith("```"), inner).otherwise(text), r"^\s+|\s+$", "")


def answered(text: Column, schema: str) -> Column:
    """A model's fenced or bare JSON answer as a struct; null where it is not such JSON."""
    return F.from_json(model_json(text), schema, {"mode": "PERMISSIVE"})


def message_body(content: Column, transcription: Column, extracted: Column) -> Column:
    """The parts of a message that are there, each under its heading, with an empty line between."""
    part = lambda heading, c: F.when(~blank(c), F.concat(F.lit(heading), c))
    return F.concat_ws("\n\n", part("Message: ", content), part("Audio transcription: ", transcription), part("Document/Image content: ", extracted))


def mail_content(subject: Column, sender: Column, date: Column, body: Column, attachments: Column | None = None) -> Column:
    """A mail as one text: header lines, body, and attachments (structs of filename and text) under their names."""
    given = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("\nSUJET: "), given(subject), F.lit("\nDE: "), given(sender), F.lit("\nDATE: "), given(date), F.lit("\n\nCONTENU:\n"), given(body), F.lit("\n"))
    if attachments is None:
        return head
    each = F.transform(attachments, lambda a: F.concat(F.lit("\n--- "), a["filename"], F.lit(" ---\n"), given(a["text"]), F.lit("\n")))
    more = F.concat(F.lit("\n\nCONTENU DES PIÈCES JOINTES:\n"), F.array_join(each, ""))
    return F.concat(head, F.when(F.size(attachments) > 0, more).otherwise(""))


#: How statuses and channels are shown.
STATUS_LABELS = {"en_attente": "⏳ Attente", "validee": "✅ Validée", "rejetee": "❌ Rejetée"}
WHATSAPP_LABEL, MAIL_LABEL = "📱 WhatsApp", "📧 Email"


def status_label(status: Column) -> Column:
    """A status as shown; an unknown one as it is."""
    out = None
    for name, label in STATUS_LABELS.items():
        out = F.when(status == name, label) if out is None else out.when(status == name, label)
    return out.otherwise(status)


def source_label(source: Column) -> Column:
    return F.when(source == "whatsapp", WHATSAPP_LABEL).otherwise(MAIL_LABEL)


def initial(name: Column) -> Column:
    """The first letter in upper case."""
    return F.upper(F.left(name, F.lit(1)))


def order_number(number: Column, id_: Column) -> Column:
    return filled(number, F.concat(F.lit("CMD-"), id_.cast("string")))


def product_shown(kind: Column, description: Column) -> Column:
    """The product's type, or else what the order says it is, or N/A."""
    return filled(kind, filled(description, F.lit("N/A")))


def amount_shown(quantity: Column, unit: Column) -> Column:
    """A quantity with its unit; N/A where there is none, and no unit where none is given."""
    return F.concat(F.coalesce(quantity.cast("string"), F.lit("N/A")), F.when(blank(unit), F.lit("")).otherwise(F.concat(F.lit(" "), unit)))


def delivery_shown(date: Column) -> Column:
    """A delivery date, or that it is to be confirmed where there is none (or one written out as None)."""
    return F.when(blank(date) | (date == "None"), F.lit("À confirmer")).otherwise(date)


def prompt_part(text: Column, n: int = 1500) -> Column:
    """The beginning of a text that goes into a prompt."""
    return F.left(text, F.lit(n))
