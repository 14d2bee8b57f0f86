"""Fixed values. All of these must equal the published behaviour for results to match."""

# --- matching -------------------------------------------------------------------------------
MATCH_WINDOW_SECONDS = 660
IDS_MODULE = "suricata"
ALERT_SEVERITIES = ["1", "2", "3"]
LOCAL_TIME_ZONE = "Asia/Ho_Chi_Minh"
INGEST_DELAY_SECONDS = 40
LOOKBACK_SECONDS = 180
POLL_SECONDS = 5
PAGE_SIZE = 20

# --- connections ----------------------------------------------------------------------------
CONN_STATE_TEXT = {
    "S0": "Connection attempt, no reply",
    "S1": "Handshake started, closed by client before completion",
    "S2": "Handshake started, closed by server before completion",
    "S3": "Handshake started, no final ACK from client",
    "REJ": "Connection rejected by server",
    "SF": "Connection established and fully closed",
    "RSTO": "Connection closed by client (RST)",
    "RSTR": "Connection closed by server (RST)",
}
FAILED_CONN_STATES = ["S0", "S1", "S2", "S3", "REJ"]

# Address blocks that are not globally reachable (IANA special registries, as in CPython 3.13).
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
PUBLIC_V4_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = [
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
PUBLIC_V6_EXCEPTIONS = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
]

# --- http -----------------------------------------------------------------------------------
ANOMALOUS_AGENTS = ["svchost.exe"]
SCRIPTING_AGENTS = ["python", "java", "curl", "wget", "powershell", "go-http-client", "bits"]
OUTDATED_AGENTS = ["msie 6", "msie 7", "msie 8", "firefox/1", "firefox/2", "firefox/3"]
HTTP_RISKY_EXTENSIONS = [
    ".exe", ".dll", "scr", ".bat", ".cmd", ".js", ".ps1", ".jar", ".bin", "php",
]
RISKY_MIME_TYPES = [
    "application/x-dosexec", "application/x-msdownload", "application/octet-stream",
    "application/zip", "application/x-rar-compressed", "application/vnd.ms-cab-compressed",
]
CONTENT_PATTERNS = {
    "Sensitive Keyword":
        r"password|passwd|pwd|token|secret|apikey|api_key|access_token|session|auth|credentials",
    "Hex-based Key": r"([a-fA-F0-9]{32,})",
    "Classic SQLi": r"(\s*')\s*(or|and)\s*(\s*\S+\s*=\s*\S+)|union\s+select|--|/\*|\*/",
    "Time-based Blind": r"benchmark\s*\(|sleep\s*\(",
    "Script Tag": r"<script|javascript:",
    "HTML Event Handler": r"onerror\s*=|onload\s*=|onmouseover\s*=",
    "Img/Svg Payload": r"<img|<svg",
    "Web Shell Command in Parameter":
        r"=\s*(whoami|uname|id|ls|cat\s|system\s*\(|exec\s*\(|passthru\s*\()",
    "Suspicious Script in Uploads":
        r"/uploads?/.*(shell|c99|r57|webadmin|admin|root| backdoor)\.php",
}
TRAVERSAL_REASON = "Potential Directory Traversal"
TRAVERSAL_MARKS = ["../", "..\\"]
DIRECT_IP_HOST = r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$"
CONTENT_GROUP_LIMIT = 3
CONTENT_EXAMPLE_CHARS = 256
DECODE_ROUNDS = 10
NO_FILENAMES = "No valid filenames recorded"

# --- dns ------------------------------------------------------------------------------------
DNS_SUSPICIOUS_TYPES = ["*", "TXT", "ANY"]
DNS_FAILURE_CODES = ["NXDOMAIN", "SERVFAIL", "REFUSED"]
DNS_SUSPICIOUS_TLDS = [
    "xyz", "icu", "cn", "tk", "pw", "sbs", "club", "top", "ru", "online",
]
DNS_LOW_TTL = 60
DNS_HIGH_ENTROPY = 3.0
DNS_LONG_QUERY = 50
DNS_MIN_QUERIES = 10
DNS_REPEATED_QUERY = 20
DNS_FAILURE_RATIO = 0.5

# --- tls ------------------------------------------------------------------------------------
MALICIOUS_JA3 = {
    "e7d4dd046396654b42318a6bd69c5e27": "TrickBot",
    "d8da247a3e3110522e4350f9684b553d": "Cobalt Strike",
    "4d7a22491b84a27776107386818e3a89": "Metasploit",
    "a95cf29d11593465851457e4235a4203": "Emotet",
}
MALICIOUS_JA3S = {
    "82365955f7547b74681308061413d939": "Cobalt Strike Server",
    "6734139f405c687aaeab3415175b3386": "Metasploit Server",
}
TRUSTED_DOMAINS = {
    "google.com": "Trusted Provider",
    "microsoft.com": "Trusted Provider",
    "ubuntu.com": "Trusted Provider",
    "facebook.net": "Trusted Provider",
    "jquery.com": "Trusted CDN",
    "typekit.net": "Trusted CDN",
}
ADWARE_KEYWORDS = [
    "ads", "adserve", "tracker", "analytics", "metrics", "pixel", "pubmatic", "algovid",
    "sitescout",
]
BENIGN_KEYWORDS = [
    "cdn", "static", "assets", "api", "content", "images", "font", "adobe", "akamai", "cloud",
    "aws",
]
WEAK_PROTOCOLS = ["SSLv3", "TLSv10", "TLSv11"]
WEAK_CIPHERS = [
    "TLS_RSA_WITH_RC4_128_MD5", "TLS_RSA_WITH_RC4_128_SHA", "TLS_RSA_EXPORT_WITH_RC4_40_MD5",
    "TLS_RSA_WITH_DES_CBC_SHA", "TLS_RSA_WITH_3DES_EDE_CBC_SHA",
]
CERTIFICATE_ISSUES = {
    "Self-Signed Certificate": "self-signed",
    "Untrusted Chain": "unable to get local issuer",
    "Expired Certificate": "has expired",
}

# --- files ----------------------------------------------------------------------------------
FILE_RISKY_EXTENSIONS = [
    ".exe", ".dll", ".scr", ".bat", ".cmd", ".js", ".ps1", ".zip", ".rar", ".jar", ".bin",
    ".vbs", ".hta", ".msi", ".docm", ".xlsm",
]
FILE_HIGH_ENTROPY = 7.5
FILE_BASE_SCORE = 5
FILE_REASON_SCORES = {
    "SUSPICIOUS_EXTENSION": 20,
    "SUSPICIOUS_MIME": 20,
    "HIGH_ENTROPY": 30,
    "MIME_MISMATCH": 40,
}
FILE_SEVERITY_FLOORS = [(90, "Critical"), (70, "High"), (40, "Medium")]
FILE_SEVERITY_RANKS = {"Informational": 0, "Medium": 1, "High": 2, "Critical": 3}
FILE_EXAMPLE_LIMIT = 5

# --- domain suffixes ------------------------------------------------------------------------
# Common suffixes of more than one label, for splits without a table of rules; the last label is
# the suffix of any other host. `operators.suffixes` splits by a whole public suffix list.
MULTI_LABEL_SUFFIXES = [
    "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "ac.jp", "co.jp", "go.jp",
    "ne.jp", "or.jp", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk",
    "plc.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "com.br", "gov.br", "net.br",
    "org.br", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.kr", "co.kr", "go.kr",
    "or.kr", "com.mx", "org.mx", "co.nz", "govt.nz", "net.nz", "org.nz", "com.sg", "edu.sg",
    "com.tr", "gov.tr", "com.tw", "edu.tw", "org.tw", "com.vn", "edu.vn", "gov.vn", "net.vn",
    "org.vn", "ac.za", "co.za", "gov.za", "org.za", "com.hk", "org.hk", "com.my", "co.id",
    "go.id", "co.th", "in.th", "com.ua", "com.ar", "com.co",
]

# --- ground truth ---------------------------------------------------------------------------
PROTOCOL_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1}
BENIGN_LABEL = "BENIGN"
FP_SAMPLES = 50
TP_SAMPLES = 150
SAMPLE_SEED = "42"
TP_QUOTAS = {
    "Web Attacks": (["Web Attack - XSS", "Web Attack - Sql Injection", "Web Attack - Brute Force"], 45),
    "Infiltration & Botnet": (["Infiltration", "Bot"], 30),
    "Brute Force": (["FTP-Patator", "SSH-Patator"], 20),
    "DoS_Scan": (["DDoS", "PortScan"], 55),
}

# --- severity rules: (level, collector, path, check, value) ------------------------------------
SEVERITY_LEVELS = ["critical", "high", "medium", "low"]
SEVERITY_RULES = [
    ("critical", "http", "analysis.user_agent_category", "equals", "Anomalous/Malformed"),
    ("critical", "http", "analysis.file_transfer_risk", "startswith", "Suspicious Upload"),
    ("critical", "dns", "analysis.overall_assessment", "startswith", "Potential Threat"),
    ("critical", "files", "analysis.highest_threat_level", "equals", "Critical"),
    ("critical", "files", "evidence.findings[*].risk_score", "gte", 90),
    ("critical", "ssl", "analysis.overall_assessment", "startswith", "High Confidence Threat"),
    ("high", "conn", "analysis.history_analysis.severity", "equals", "High"),
    ("high", "http", "analysis.download_risk", "equals", "Executable Content Detected"),
    ("high", "http", "analysis.destination_analysis", "equals", "Direct-to-IP Connection"),
    ("high", "http", "analysis.user_agent_category", "equals", "Scripting/Tool"),
    ("high", "http", "analysis.content_risk", "equals", "Suspicious Content Detected"),
    ("high", "http", "analysis.file_transfer_risk", "startswith", "Suspicious Download"),
    ("high", "ssl", "analysis.overall_assessment", "startswith", "Suspicious Anomaly"),
    ("high", "dns", "analysis.observed_query_pattern", "equals", "High Entropy (DGA-like)"),
    ("high", "dns", "analysis.observed_query_pattern", "equals", "Repetitive (Beaconing-like)"),
    ("high", "files", "analysis.evasion_techniques_detected", "equals", "Yes"),
    ("high", "files", "evidence.findings[*].reasons", "contains", "MIME_MISMATCH"),
    ("high", "files", "evidence.findings[*].reasons", "contains", "HIGH_ENTROPY"),
    ("medium", "conn", "analysis.history_analysis.severity", "equals", "Medium"),
    ("medium", "http", "analysis.user_agent_category", "equals", "Outdated Browser"),
    ("medium", "http", "statistics.client_error_ratio", "gte", 0.7),
    ("medium", "http", "analysis.transfer_volume", "equals", "Large"),
    ("medium", "dns", "analysis.observed_tld_risk", "equals", "Contains Monitored TLDs"),
    ("medium", "files", "statistics.suspicious_files_count", "gte", 1),
    ("medium", "files", "evidence.findings[*].reasons", "contains", "SUSPICIOUS_EXTENSION"),
    ("medium", "files", "evidence.findings[*].reasons", "contains", "SUSPICIOUS_MIME"),
    ("medium", "ssl", "analysis.overall_assessment", "startswith", "Informational"),
    ("low", "dns", "analysis.observed_ttl_behavior", "startswith", "Low"),
    ("low", "ssl", "analysis.handshake_status", "equals", "Failed"),
]

# --- verdicts -------------------------------------------------------------------------------
FALSE_POSITIVE = "False Positive"
NO_EVIDENCE_THOUGHT = (
    "Initial check: The context is missing the 'connection' and/or 'evidence' objects. As per "
    "CRITICAL RULE #3, without corroborating signals, the alert must be classified as 'False "
    "Positive'. Bypassing full analysis."
)
NO_EVIDENCE_ALERT = (
    "The alert signature '%s' suggests a potential threat, but this is only a claim that requires "
    "corroboration."
)
NO_EVIDENCE_SIGNALS = (
    "No corroborating signals were found. Neither connection details nor specific evidence (HTTP, "
    "DNS, etc.) could be retrieved for this event."
)
NO_EVIDENCE_SYNTHESIS = (
    "The event triggered an alert, but a search for contextual data yielded no supporting "
    "evidence. The activity is therefore considered unproven and benign by definition."
)
NO_EVIDENCE_SUMMARY = (
    "Classified as False Positive due to a complete lack of corroborating evidence from network "
    "logs."
)
PENDING_VERDICT = "Pending"
PENDING_SUMMARY = "No summary available."
CONTEXT_SLOT = "{{ENRICHED_PROMPT}}"
REQUEST_TEMPERATURE = 0.0
REQUEST_MAX_TOKENS = 2048
