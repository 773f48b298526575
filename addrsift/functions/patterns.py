"""Fixed values shared by the extraction functions.

Everything here is a constant that results depend on: patterns, word lists
and region codes.  Patterns are Java regular expressions; word boundaries
are spelt out so that they are ASCII-only on every JVM version.
"""

# --- fixed values: addresses -------------------------------------------------

WORD = "[0-9A-Za-z_]"
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
HEXTET = "[0-9a-fA-F]{1,4}"

NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
AFTER_WORD = f"(?<={WORD})"
BEFORE_WORD = f"(?={WORD})"

# The first lookahead only makes positions that cannot start a match fail at once.
IPV4 = f"(?=[0-9]){NOT_AFTER_WORD}(?:{OCTET}\\.){{3}}{OCTET}{NOT_BEFORE_WORD}"

# First matching alternative wins, so compressed addresses are cut after "::".
IPV6_REFERENCE = "(?=[0-9a-fA-F]{0,4}:)(?:" + "|".join([
    f"{NOT_AFTER_WORD}(?:{HEXTET}:){{7}}{HEXTET}{NOT_BEFORE_WORD}",
    f"{NOT_AFTER_WORD}(?:{HEXTET}:){{1,7}}:{BEFORE_WORD}",
    f"{NOT_AFTER_WORD}(?:{HEXTET}:){{1,6}}:{HEXTET}{NOT_BEFORE_WORD}",
    f"{AFTER_WORD}::(?:{HEXTET}:){{0,5}}{HEXTET}{NOT_BEFORE_WORD}",
    f"{NOT_AFTER_WORD}{HEXTET}::(?:{HEXTET}:){{0,5}}{HEXTET}{NOT_BEFORE_WORD}",
    f"{AFTER_WORD}::ffff:(?:{OCTET}\\.){{3}}{OCTET}{NOT_BEFORE_WORD}",
]) + ")"

# Longest alternative first: whole compressed addresses.
IPV6_FULL = (
    "(?<![0-9A-Za-z_:.])(?:"
    + "|".join(
        [f"(?:{HEXTET}:){{7}}{HEXTET}"]
        + [f"(?:{HEXTET}:){{1,{7 - k}}}(?::{HEXTET}){{1,{k}}}" for k in range(1, 7)]
        + [f":(?::{HEXTET}){{1,7}}", f"(?:{HEXTET}:){{1,7}}:"]
    )
    + ")(?![0-9A-Za-z_:]|\\.[0-9])"
)

# --- fixed values: time stamps, tried in this order -------------------------

DATE_SPACE = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
DATE_T = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
DATE_APACHE = r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})"
DATE_SYSLOG = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
DATE_ONLY = r"(\d{4}-\d{2}-\d{2})"

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
YEARLESS = 1900

# --- fixed values: time units ------------------------------------------------

UNIT_SECONDS = {
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
    "mo": 2592000, "month": 2592000, "months": 2592000,
    "y": 31536000, "yr": 31536000, "year": 31536000, "years": 31536000,
}

# --- fixed values: words that mark a failed login ---------------------------

FAILURE_KEYWORDS = [
    "failed", "failure", "fail",
    "wrong password", "wrong username",
    "invalid password", "invalid username", "invalid user",
    "authentication failure", "authentication failed", "auth failed", "auth failure",
    "denied", "no access", "access denied", "blocked", "banned",
    "unsuccessful", "not allowed", "rejected",
    "bad password", "incorrect password", "incorrect username",
    "login denied", "login failed", "logon failure", "bad login",
    "bad credentials", "invalid credentials",
    "unknown user", "user not found", "no such user",
    "lockout", "locked out", "too many attempts", "brute force",
]

# --- fixed values: regions ---------------------------------------------------

EU_COUNTRIES = [
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE",
    "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE",
]
GDPR_COUNTRIES = EU_COUNTRIES + ["IS", "LI", "NO", "GB", "CH"]

# --- fixed values: registered domains ---------------------------------------

SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac"]
SECOND_LEVEL_TLDS = ["uk", "au", "nz", "za", "br", "jp"]

# --- fixed values: delimited layouts ----------------------------------------

DELIMITERS = [",", ";", "|", "\t"]
SAMPLE_LINES = 20

# --- fixed values: threat lists ----------------------------------------------

THREAT_LISTS = [
    "CINSBadRep", "PeerDrop", "NordVPN_v4", "NordVPN_v6", "Mullvad_v4", "Mullvad_v6", "PhishTank",
]

# --- fixed values: column headings of the table view -------------------------

DISPLAY_NAMES = {
    "ping": "Ping / Alive",
    "tls_cn": "CN", "tls_issuer": "Issuer", "tls_algorithm": "Algorithm",
    "tls_created": "Created", "tls_expires": "Expires", "tls_version": "TLS Ver",
    "tls_keysize": "KeySize",
    "http_port": "Port", "http_status": "Status", "http_server": "Server",
    "http_csp": "CSP", "http_title": "Title",
}
