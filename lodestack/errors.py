"""Error codes, versions, and the settings of a session that commands share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version of this library as (major, minor, patch).
VERSION = (0, 2, 0)

#: Numbers and names of the errors.
ERRORS = {
    0: "SUCCESS",
    1: "ALREADY_LOCKED",
    2: "DECOMPRESSION",
    6: "FUSE",
    8: "GLOB_HAD_NO_MATCHES",
    10: "IMAGE_COUNT",
    11: "IMAGE_NAME_COLLISION",
    12: "INSUFFICIENT_PRIVILEGES",
    13: "INTEGRITY",
    14: "INVALID_CAPTURE_CONFIG",
    15: "INVALID_CHUNK_SIZE",
    16: "INVALID_COMPRESSION_TYPE",
    17: "INVALID_HEADER",
    18: "INVALID_IMAGE",
    19: "INVALID_INTEGRITY_TABLE",
    20: "INVALID_LOOKUP_TABLE_ENTRY",
    21: "INVALID_METADATA_RESOURCE",
    23: "INVALID_OVERLAY",
    24: "INVALID_PARAM",
    25: "INVALID_PART_NUMBER",
    26: "INVALID_PIPABLE_WIM",
    27: "INVALID_REPARSE_DATA",
    28: "INVALID_RESOURCE_HASH",
    30: "INVALID_UTF16_STRING",
    31: "INVALID_UTF8_STRING",
    32: "IS_DIRECTORY",
    33: "IS_SPLIT_WIM",
    35: "LINK",
    36: "METADATA_NOT_FOUND",
    37: "MKDIR",
    38: "MQUEUE",
    39: "NOMEM",
    40: "NOTDIR",
    41: "NOTEMPTY",
    42: "NOT_A_REGULAR_FILE",
    43: "NOT_A_WIM_FILE",
    44: "NOT_PIPABLE",
    45: "NO_FILENAME",
    46: "NTFS_3G",
    47: "OPEN",
    48: "OPENDIR",
    49: "PATH_DOES_NOT_EXIST",
    50: "READ",
    51: "READLINK",
    52: "RENAME",
    54: "REPARSE_POINT_FIXUP_FAILED",
    55: "RESOURCE_NOT_FOUND",
    56: "RESOURCE_ORDER",
    57: "SET_ATTRIBUTES",
    58: "SET_REPARSE_DATA",
    59: "SET_SECURITY",
    60: "SET_SHORT_NAME",
    61: "SET_TIMESTAMPS",
    62: "SPLIT_INVALID",
    63: "STAT",
    65: "UNEXPECTED_END_OF_FILE",
    66: "UNICODE_STRING_NOT_REPRESENTABLE",
    67: "UNKNOWN_VERSION",
    68: "UNSUPPORTED",
    69: "UNSUPPORTED_FILE",
    71: "WIM_IS_READONLY",
    72: "WRITE",
    73: "XML",
    74: "WIM_IS_ENCRYPTED",
    75: "WIMBOOT",
    76: "ABORTED_BY_PROGRESS",
    77: "UNKNOWN_PROGRESS_STATUS",
    78: "MKNOD",
    79: "MOUNTED_IMAGE_IS_BUSY",
    80: "NOT_A_MOUNTPOINT",
    81: "NOT_PERMITTED_TO_UNMOUNT",
    82: "FVE_LOCKED_VOLUME",
    83: "UNABLE_TO_READ_CAPTURE_CONFIG",
    84: "WIM_IS_INCOMPLETE",
    85: "COMPACTION_NOT_POSSIBLE",
    86: "IMAGE_HAS_MULTIPLE_REFERENCES",
    87: "DUPLICATE_EXPORTED_IMAGE",
    88: "CONCURRENT_MODIFICATION_DETECTED",
    89: "SNAPSHOT_FAILURE",
    90: "INVALID_XATTR",
    91: "SET_XATTR",
}
#: Errors that Python has a class for.
_CLASSES = {
    "PATH_DOES_NOT_EXIST": FileNotFoundError,
    "NOTDIR": NotADirectoryError,
    "IS_DIRECTORY": IsADirectoryError,
    "INVALID_PARAM": ValueError,
    "NOTEMPTY": OSError,
}


def error_number(name: str) -> int:
    return next(n for n, x in ERRORS.items() if x == name)


def error_of(error: BaseException) -> int:
    """The number that stands for an error that was raised here; UNSUPPORTED for any other."""
    for name, kind in _CLASSES.items():
        if type(error) is kind:
            return error_number(name)
    return error_number("UNSUPPORTED")


def error_text(code: Column) -> Column:
    """Names of error numbers in lower case and words, such as ``invalid header``."""
    table = F.create_map(*(F.lit(x) for n, name in ERRORS.items() for x in (n, name.lower().replace("_", " "))))
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("unknown error"))


def version_text() -> str:
    return ".".join(map(str, VERSION))


def version_number() -> int:
    """The version as one number, 20 bits for the major, 10 for the others."""
    major, minor, patch = VERSION
    return major << 20 | minor << 10 | patch
