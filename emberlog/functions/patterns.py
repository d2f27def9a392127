"""Masks for variable parts of messages, and presets of masks and mining settings by source."""

from __future__ import annotations

from dataclasses import dataclass

#: Named masks.
PATTERNS = {
    "ipv4_address_with_port": r"(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?",
    "mac_address": r"(?:[\dxa-fA-F]{2}[-:]){5}[\dxa-fA-F]{2}",
    "linux_path": r"(?:[\w.*~%@-]+:?)?(?:/[\w.*~%@+,-]+){2,}/?",
    "windows_path": r"(?:[\w.*~%@-]+:?)?(?:\\[\w.*~%@+,-]+){2,}\\?",
    "hdfs_block": r"blk(?:_-?\d+){1,2}",
    "hdfs_url": r"hdfs://[\w.:@-]*(?:(?:/[\w.~%+-]+)+/?)?",
    "http_url": r"https?://[\w.:@-]*(?:(?:/[\w.~%?&=-]+)+/?)?",
    "java_identifier": r"(?:[\w$]+\.){2,}[\w$<>]+",
    "trace": r"^\[(?:[0-9a-fA-F]+, ?){2}[0-9a-fA-F]+\]",
    "hex_number": r"\b0[Xx][a-fA-F\d]+\b",
    "hex_segment": r"\b[a-fA-F\d]{6,}\b",
    "hex_identifier": r"\b(?=[\d-]*[a-fA-F])(?:[a-fA-F\d]{2,}-){2,}[a-fA-F\d]{2,}\b",
    "number": r"[+-]?\b\d+(?:\.\d+(?:-?[eE]\d+)?)?\b",
    "java_stackentry": r"(?:[\w$]+\.)+[\w$<>]+\((?:\w*\.\w+:\d*|[\w$<>\s]*)\)",
    "rtsp_url": r"rtsp://[\w.:@-]*(?:/[\w.-=]+)+",
    "ipv6_address_with_port": r"\[?(?:^|(?<=\W))(?:[\da-fA-F]{1,4}:|:){4,}(?:[\da-fA-F]{1,4}|:)(?:\]|(?=\W)|$)(?::\d{1,5})?",
    "ipv6_address_with_ipv4_with_port": r"\[?(?:^|(?<=\W))(?:[\da-fA-F]{1,4}:|:){2,}(?:\d{1,3}\.){3}\d{1,3}(?:\]|(?=\W)|$)(?::\d{1,5})?",
    "long_numerical_list": r"(?:^|(?<=\W))(?:[-+]?[\dxa-fA-F.]+[ ,;:|/#*-]+){5,}[-+]?[\dxa-fA-F.]+\b",
    "number_with_unit": r"(?<=[<>(\[/.\x27,:=\s])[+-]?\b\d+(?:\.\d+(?:-?[eE]\d+)?)?(?:[numcdkKMGT]?(?:s|m|g|Ah|A|K|°C|Hz|N|J|W|V|B(?:ytes?)?|b(?:its?)?)(?:[/p]s)?)\b",
    "content_or_condition_uri": r"(?:content|condition)://(?:[\w.*~%@-]+:?)?(?:/[\w.*~%?&=-]+)*/?",
    "core_path": r"core\.\d+",
    "attempt_id": r"(?:app)?attempt_\d+_\w+",
    "container_id": r"container_\d+_\d+_\d+_\d+",
    "task_id": r"task_\d+_\d+_\w_\d+",
    "job_id": r"job_\d+_[\d_]+",
    "host_uri": r"(?:[\w-]+\.)+[\w-]+(?::\d+)?",
}
PATTERNS["file_url"] = rf"file://(?:(?:{PATTERNS['linux_path']})|(?:{PATTERNS['windows_path']}))"
PATTERNS["tcp_url"] = "tcp://" + PATTERNS["ipv4_address_with_port"]

Mask = tuple[str, str]
_IP = PATTERNS["ipv4_address_with_port"]
#: The name of masks without one.
UNNAMED = "@"


def masks(*names: str) -> tuple[Mask, ...]:
    return tuple((n, PATTERNS[n]) for n in names)


@dataclass(frozen=True)
class MiningSettings:
    """similarity: share of equal tokens that joins a message to a template; depth: of the search tree; masks: in order."""

    similarity: float = 0.4
    depth: int = 4
    masks: tuple[Mask, ...] = ()


_HADOOP = (
    *masks("hdfs_url", "http_url", "linux_path", "windows_path"),
    ("block_id", rf"BP-\d+-{_IP}-\d+:{PATTERNS['hdfs_block']}"),
    *masks("attempt_id", "container_id", "task_id", "job_id"),
    ("ipv4_address_with_port", "/?" + _IP),
    *masks("java_stackentry", "java_identifier"),
    ("number", r"(?<=[:=+])[+-]?\b\d+(?:\.\d+(?:-?[eE]\d+)?)?"),
)

#: Settings by source.
PRESETS = {
    "android": MiningSettings(0.2, 6, masks("trace", "http_url", "file_url", "content_or_condition_uri", "tcp_url", "linux_path", "java_identifier", "mac_address", "hex_number", "hex_identifier", "number", "hex_segment")),
    "telcoapp": MiningSettings(
        0.2,
        6,
        masks(
            "rtsp_url", "http_url", "file_url", "content_or_condition_uri", "tcp_url", "linux_path", "java_identifier", "ipv6_address_with_ipv4_with_port", "ipv6_address_with_port", "mac_address", "long_numerical_list",
            "hex_number", "hex_identifier", "number_with_unit", "number", "hex_segment",
        ),
    ),
    "apache": MiningSettings(0.5, 4, ((UNNAMED, _IP),)),
    "bgl": MiningSettings(0.5, 4, masks("ipv4_address_with_port", "linux_path", "core_path", "hex_number", "number", "hex_segment")),
    "hdfs": MiningSettings(0.5, 4, (*masks("linux_path"), ("block_id", PATTERNS["hdfs_block"]), ("ipv4_address_with_port", "/?" + _IP))),
    "hpc": MiningSettings(0.5, 4, ((UNNAMED, r"(?<==)\d+"),)),
    "hadoop": MiningSettings(0.5, 4, _HADOOP),
    "healthapp": MiningSettings(0.2, 4),
    "linux": MiningSettings(0.39, 6, ((UNNAMED, _IP), (UNNAMED, r"\d{2}:\d{2}:\d{2}"))),
    "mac": MiningSettings(0.7, 6, ((UNNAMED, PATTERNS["java_identifier"]),)),
    "openssh": MiningSettings(0.6, 5, ((UNNAMED, _IP), (UNNAMED, PATTERNS["java_identifier"]))),
    "openstack": MiningSettings(0.5, 5, ((UNNAMED, rf"(?:{_IP},?)+"), (UNNAMED, r"/.+?\s"), (UNNAMED, r"\d+"))),
    "proxifier": MiningSettings(0.6, 3, (*masks("host_uri"), ("timestamp", r"<\d+\ssec"), ("timestamp", r"\b\d{2}:\d{2}(?::\d{2})*\b"), *masks("number"))),
    "spark": MiningSettings(0.5, 4, _HADOOP),
    "thunderbird": MiningSettings(0.5, 4, ((UNNAMED, _IP),)),
    "windows": MiningSettings(0.7, 5, ((UNNAMED, r"0x.*?\s"),)),
    "zookeeper": MiningSettings(0.5, 4, (("ipv4_address_with_port", "/?" + _IP), *masks("hex_number"))),
}
