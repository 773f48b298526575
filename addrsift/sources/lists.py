"""Threat lists and network tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import _col

_BLANK = " \t\r\n"


def list_name(path: Column | str) -> Column:
    """Short list name of a file path or address.

    Fixed values: the name fragments and the names they stand for.
    """
    path = _col(path)
    file = F.substring_index(path, "/", -1)
    dot = F.instr(file, ".csv")
    file = F.when(dot > 0, F.substr(file, F.lit(1), dot - 1)).otherwise(file)
    vpn = (
        F.when(file.contains("nordvpn") | path.contains("nordvpn"), "NordVPN")
        .when(file.contains("mullvad") | path.contains("mullvad"), "Mullvad")
    )
    family = F.when(file.contains("ipv4"), "_v4").when(file.contains("ipv6"), "_v6")
    return (
        F.when(file.contains("cinsscore") | file.contains("badrep"), "CINSBadRep")
        .when(file.contains("spamhaus") | file.contains("peer-drop"), "PeerDrop")
        .when(file.contains("phishtank"), "PhishTank")
        .otherwise(F.coalesce(F.concat(vpn, family), F.translate(file, "-", "_")))
    )


def parse_threat_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a threat list: adds ``network`` and ``message``, drops other lines.

    Kept lines have a comma before which something stands and do not start
    with ``#``; the message loses one pair of quotes around it.
    """
    line = F.col(value)
    comma = F.instr(line, ",")
    message = F.trim(F.substr(line, comma + 1), F.lit(_BLANK))
    quoted = (F.length(message) >= 2) & message.startswith('"') & message.endswith('"')
    return (
        lines.where(~line.startswith("#") & (comma > 0))
        .withColumn("network", F.trim(F.substring_index(line, ",", 1), F.lit(_BLANK)))
        .withColumn(
            "message",
            F.when(quoted, F.substr(message, F.lit(2), F.length(message) - 2)).otherwise(message),
        )
        .where(F.col("network") != "")
    )


def read_threat_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(list_name, network, message) of threat list files, named after their paths."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("path")
    )
    return parse_threat_list(raw).select(
        list_name("path").alias("list_name"), "network", "message"
    )
