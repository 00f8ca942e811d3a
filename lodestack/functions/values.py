"""Times, attributes, numbers and texts of entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601 to 1970, ticks in a microsecond.
EPOCH_SECONDS, TICKS = 11_644_473_600, 10
#: Attribute bits.
ATTRIBUTES = {
    "readonly": 0x1, "hidden": 0x2, "system": 0x4, "directory": 0x10, "archive": 0x20, "device": 0x40, "normal": 0x80, "temporary": 0x100,
    "sparse": 0x200, "reparse_point": 0x400, "compressed": 0x800, "offline": 0x1000, "not_indexed": 0x2000, "encrypted": 0x4000, "virtual": 0x10000,
}
#: Reparse tags of symbolic links and mount points; tags of UNIX data.
SYMLINK_TAGS, UNIX_DATA_TAG = (0xA000000C, 0xA0000003), 0x337DD873
#: Compression types by number; sizes of a unit.
COMPRESSIONS = ("None", "XPRESS", "LZX", "LZMS")
UNITS = ((30, "GiB"), (20, "MiB"), (10, "KiB"))
#: Public language numbers and names.
LANGUAGES = {
    0x0401: "ar-SA", 0x0402: "bg-BG", 0x0403: "ca-ES", 0x0404: "zh-TW", 0x0405: "cs-CZ", 0x0406: "da-DK", 0x0407: "de-DE", 0x0408: "el-GR",
    0x0409: "en-US", 0x040A: "es-ES_tradnl", 0x040B: "fi-FI", 0x040C: "fr-FR", 0x040D: "he-IL", 0x040E: "hu-HU", 0x040F: "is-IS", 0x0410: "it-IT",
    0x0411: "ja-JP", 0x0412: "ko-KR", 0x0413: "nl-NL", 0x0414: "nb-NO", 0x0415: "pl-PL", 0x0416: "pt-BR", 0x0417: "rm-CH", 0x0418: "ro-RO",
    0x0419: "ru-RU", 0x041A: "hr-HR", 0x041B: "sk-SK", 0x041C: "sq-AL", 0x041D: "sv-SE", 0x041E: "th-TH", 0x041F: "tr-TR", 0x0420: "ur-PK",
    0x0421: "id-ID", 0x0422: "uk-UA", 0x0423: "be-BY", 0x0424: "sl-SI", 0x0425: "et-EE", 0x0426: "lv-LV", 0x0427: "lt-LT", 0x0429: "fa-IR",
    0x042A: "vi-VN", 0x042B: "hy-AM", 0x042D: "eu-ES", 0x042E: "hsb-DE", 0x042F: "mk-MK", 0x0432: "tn-ZA", 0x0434: "xh-ZA", 0x0435: "zu-ZA",
    0x0436: "af-ZA", 0x0437: "ka-GE", 0x0438: "fo-FO", 0x0439: "hi-IN", 0x043A: "mt-MT", 0x043E: "ms-MY", 0x043F: "kk-KZ", 0x0440: "ky-KG",
    0x0441: "sw-KE", 0x0442: "tk-TM", 0x0444: "tt-RU", 0x0445: "bn-IN", 0x0446: "pa-IN", 0x0447: "gu-IN", 0x0448: "or-IN", 0x0449: "ta-IN",
    0x044A: "te-IN", 0x044B: "kn-IN", 0x044C: "ml-IN", 0x044D: "as-IN", 0x044E: "mr-IN", 0x044F: "sa-IN", 0x0450: "mn-MN", 0x0451: "bo-CN",
    0x0452: "cy-GB", 0x0453: "km-KH", 0x0454: "lo-LA", 0x0456: "gl-ES", 0x0457: "kok-IN", 0x045A: "syr-SY", 0x045B: "si-LK", 0x045E: "am-ET",
    0x0461: "ne-NP", 0x0462: "fy-NL", 0x0463: "ps-AF", 0x0464: "fil-PH", 0x0465: "dv-MV", 0x046A: "yo-NG", 0x046D: "ba-RU", 0x046E: "lb-LU",
    0x046F: "kl-GL", 0x0470: "ig-NG", 0x0478: "ii-CN", 0x047A: "arn-CL", 0x047C: "moh-CA", 0x047E: "br-FR", 0x0480: "ug-CN", 0x0481: "mi-NZ",
    0x0482: "oc-FR", 0x0483: "co-FR", 0x0484: "gsw-FR", 0x0485: "sah-RU", 0x0487: "rw-RW", 0x0488: "wo-SN", 0x048C: "prs-AF", 0x0801: "ar-IQ",
    0x0804: "zh-CN", 0x0807: "de-CH", 0x0809: "en-GB", 0x080A: "es-MX", 0x080C: "fr-BE", 0x0810: "it-CH", 0x0813: "nl-BE", 0x0814: "nn-NO",
    0x0816: "pt-PT", 0x081A: "sr-Latn-CS", 0x081D: "sv-FI", 0x083C: "ga-IE", 0x083E: "ms-BN", 0x0845: "bn-BD", 0x0C01: "ar-EG", 0x0C04: "zh-HK",
    0x0C07: "de-AT", 0x0C09: "en-AU", 0x0C0A: "es-ES", 0x0C0C: "fr-CA", 0x0C1A: "sr-Cyrl-CS", 0x1001: "ar-LY", 0x1004: "zh-SG", 0x1007: "de-LU",
    0x1009: "en-CA", 0x100A: "es-GT", 0x100C: "fr-CH", 0x1401: "ar-DZ", 0x1404: "zh-MO", 0x1407: "de-LI", 0x1409: "en-NZ", 0x140A: "es-CR",
    0x140C: "fr-LU", 0x1801: "ar-MA", 0x1809: "en-IE", 0x180A: "es-PA", 0x180C: "fr-MC", 0x1C01: "ar-TN", 0x1C09: "en-ZA", 0x1C0A: "es-DO",
    0x2009: "en-JM", 0x200A: "es-VE", 0x240A: "es-CO", 0x280A: "es-PE", 0x2C0A: "es-AR", 0x300A: "es-EC", 0x340A: "es-CL", 0x380A: "es-UY",
    0x3C0A: "es-PY", 0x4009: "en-IN", 0x400A: "es-BO", 0x440A: "es-SV", 0x480A: "es-HN", 0x4C0A: "es-NI", 0x500A: "es-PR", 0x540A: "es-US",
}


def filetime_of(ts: Column) -> Column:
    """Ticks of 100 ns since 1601 of a timestamp."""
    return (F.unix_micros(ts.cast("timestamp")) + F.lit(EPOCH_SECONDS * 1_000_000)) * TICKS


def timestamp_of(filetime: Column) -> Column:
    """Timestamp of ticks; the last digit is below its resolution."""
    return F.timestamp_micros(micros_of(filetime))


def micros_of(filetime: Column) -> Column:
    """Microseconds since 1970; whole numbers throughout."""
    return F.call_function("div", filetime, F.lit(TICKS)) - F.lit(EPOCH_SECONDS * 1_000_000)


def shown_time(filetime: Column) -> Column:
    """Like ``Tue Mar 05 10:00:00 2024 UTC``; the session's zone must be UTC."""
    return F.date_format(timestamp_of(filetime), "EEE MMM dd HH:mm:ss yyyy 'UTC'")


def filetime_of_parts(high: Column, low: Column) -> Column:
    """From two hexadecimal 32-bit texts such as ``0x01DA6E00``."""
    number = lambda c: F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("long")
    return F.shiftleft(number(high), 32).bitwiseOR(number(low))


def has_bit(attributes: Column, name: str) -> Column:
    return attributes.bitwiseAND(F.lit(ATTRIBUTES[name])) != 0


def attribute_names(attributes: Column) -> Column:
    """Names of the bits that are set, in the order of the bits."""
    return F.filter(F.array(*(F.when(has_bit(attributes, n), n) for n in ATTRIBUTES)), lambda x: x.isNotNull())


def is_directory(attributes: Column) -> Column:
    """A directory that is no reparse point."""
    return has_bit(attributes, "directory") & ~has_bit(attributes, "reparse_point")


def is_symlink(attributes: Column, tag: Column) -> Column:
    return has_bit(attributes, "reparse_point") & F.coalesce(tag.isin(*SYMLINK_TAGS), F.lit(False))


def compression_name(number: Column) -> Column:
    out = F.lit("Unknown")
    for i, name in enumerate(COMPRESSIONS):
        out = F.when(number == i, name).otherwise(out)
    return out


def language_name(number: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), number)


def number_of(text: Column) -> Column:
    """A whole text that is a number, decimal or 0x hexadecimal; 0 for any other."""
    value = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 16), 16, 10)).when(text.rlike(r"^\d+$"), text)
    return F.coalesce(value.try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def shown_size(size: Column) -> Column:
    """Whole GiB, MiB, KiB or bytes; the unit is the largest of which there are at least ten. Sizes are whole numbers, decimals
    of up to 38 digits included."""
    size = size.cast("decimal(38,0)")
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    for shift, unit in reversed(UNITS):
        whole = ((size - size % (1 << shift)) / (1 << shift)).cast("decimal(38,0)")  # a quotient with a fraction would be rounded
        out = F.when(size >= 10 << shift, F.concat(whole.cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out
