"""Detection rules as data: subcodes, classes, scores and patterns."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    kind: str
    subcode: str
    category: str
    intent: str
    severity: str
    confidence: str
    score: int
    pattern: str


def either(words: str) -> str:
    """One of the words; a hyphen stands for whatever separates the parts of one."""
    return "(?:" + "|".join(w.replace("-", r"\W+") for w in words.split()) + ")"


def phrase(*sets: str, apart: int = 0) -> str:
    """A word of each set in turn, with up to `apart` other words between two, in whatever case."""
    between = rf"(?:\W+\w+){{0,{apart}}}\W+" if apart else r"\W+"
    return rf"(?:^|\W){between.join(map(either, sets))}(?:\W|\z)"


def phrases(*alternatives: str) -> str:
    return "(?i)" + "|".join(alternatives)


#: The names by which a text may call the tool that guards it (AS-001).
GUARD = "lodewatch security-scanner"
# What agents must not be told, as sets of words: to stop or weaken what guards them, to publish or run
# what nobody looked at, to take rights.
STOPPING = "bypass deactivate disable ignore mute skip stop suppress turn-off uninstall"
WEAKENING = "bypass disable ignore override relax turn-off"
GUARDS = "guard policies policy protection restriction restrictions rule rules security"
GATES = "approval check checks ci pipeline review"
PUBLISHING = "commit land make merge push ship"
UNSEEN = "directly no-approval no-review straight-to-main to-production without-approval without-asking without-pr without-review"
RIGHTS = "access all any nopasswd permission permissions privileges"
_HOOK = r"\"(?:preinstall|postinstall|prepare)\"\s*:\s*\"[^\"]*"
_QUOTE = r"['\"]?"
_RUNNERS = either("bash chmod deno node perl php powershell pwsh python python2 python3 ruby sh source")
_THEN_RUN = rf"(?:&&|;)\s*(?:{_RUNNERS}\b|\.?/\w|\.\s)"
_LOADERS = [either("curl wget"), either("Invoke-RestMethod Invoke-WebRequest irm iwr").replace(r"\W+", "-")]

# The line rules in natural order. A character before a word is tested by a group and
# not by look-behind, and a repetition at an end of a pattern stands once, so that a line is met by
# the same pattern in every engine and in linear time.
LINE_RULES = [
    Rule("UNSAFE_EVAL", "SAST-EVAL", "malware", "MALICIOUS", "CRITICAL", "high", 90, r"\beval\s*\(|\bnew\s+Function\s*\(|globalThis\[\s*['\"]ev['\"]\s*\+\s*['\"]al['\"]\s*\]"),
    Rule("OS_CAPABILITY", "SAST-PROCESS", "malware", "SUSPICIOUS", "MEDIUM", "high", 50, r"require\s*\(['\"]child_process['\"]\)|(?:^|[^.])\b(?:spawn|exec|execSync)\b"),
    Rule("NETWORK_ACTIVITY", "SAST-NETWORK", "malware", "NEUTRAL", "LOW", "medium", 15, r"\bfetch\s*\(|https?\.request|axios\.|got\.|curl|wget"),
    Rule("ENV_ACCESS", "SAST-ENV", "malware", "SUSPICIOUS", "MEDIUM", "high", 50, r"process\.env\.[A-Z_]{4}|secrets\.|private_key"),
    Rule("POTENTIAL_SECRET", "SAST-BASE64", "malware", "MALICIOUS", "HIGH", "high", 70, r"Buffer\.from\s*\(.*['\"]base64['\"]\)"),
    Rule("DOM_INJECTION", "SAST-DOM", "vulnerability", "VULNERABILITY", "HIGH", "high", 70, r"(?:inner|outer)HTML\s*="),
    Rule("SANDBOX_ESCAPE", "SAST-VM", "malware", "SUSPICIOUS", "HIGH", "high", 70, r"vm\.runIn(?:New)?Context"),
    Rule("SECRET_AWS_KEY_ID", "SEC-AWS-ID", "secret", "EXFILTRATION", "CRITICAL", "high", 90, rf"(?:AWS|aws)_ACCESS_KEY_ID\s*[=:]\s*{_QUOTE}AKIA[0-9A-Z]{{16}}"),
    Rule("SECRET_AWS_SECRET", "SEC-AWS-SECRET", "secret", "EXFILTRATION", "CRITICAL", "high", 95, rf"(?:AWS|aws)_SECRET_ACCESS_KEY\s*[=:]\s*{_QUOTE}[A-Za-z0-9/+=]{{40}}"),
    Rule("SECRET_AWS_KEY_ID", "SEC-AWS-ID-BARE", "secret", "EXFILTRATION", "CRITICAL", "high", 90, r"(?:^|[^0-9a-zA-Z])AKIA[0-9A-Z]{16}(?:[^0-9a-zA-Z]|\z)"),
    Rule("SECRET_GITHUB_TOKEN", "SEC-GITHUB-TOKEN", "secret", "EXFILTRATION", "CRITICAL", "high", 90, r"gh[opsu]_[0-9a-zA-Z]{36}|github_pat_[0-9a-zA-Z]{22}"),
    Rule("SECRET_STRIPE_KEY", "SEC-STRIPE", "secret", "EXFILTRATION", "CRITICAL", "high", 90, r"[sp]k_live_[0-9a-zA-Z]{24}"),
    Rule("SECRET_SENDGRID_KEY", "SEC-SENDGRID", "secret", "EXFILTRATION", "CRITICAL", "high", 90, r"SG\.[A-Za-z0-9_-]{40}"),
    Rule("SECRET_SSH_KEY", "SEC-SSH-KEY", "secret", "EXFILTRATION", "CRITICAL", "high", 95, r"-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH|PGP)\s+PRIVATE\s+KEY-----"),
    Rule("SECRET_SLACK_TOKEN", "SEC-SLACK-TOKEN", "secret", "EXFILTRATION", "CRITICAL", "high", 90, r"xox[abp]-[0-9a-zA-Z]{10}"),
    Rule("SECRET_SLACK_WEBHOOK", "SEC-SLACK-WEBHOOK", "secret", "EXFILTRATION", "CRITICAL", "high", 85, r"https://hooks\.slack\.com/services/T[A-Za-z0-9_]{8,}/B[A-Za-z0-9_]{8,}/[A-Za-z0-9_]{24}"),
    Rule("SECRET_JWT", "SEC-JWT", "secret", "EXFILTRATION", "HIGH", "high", 75, rf"(?:JWT|jwt)_?(?:SECRET|KEY|TOKEN)\s*[=:]\s*{_QUOTE}[A-Za-z0-9_.-]{{16}}"),
    Rule("SECRET_DB_PASSWORD", "SEC-DB-PASSWORD", "secret", "EXFILTRATION", "HIGH", "high", 75, rf"(?:PASSWORD|PASS|PWD)\s*[=:]\s*{_QUOTE}[A-Za-z0-9!@#$%^&*()_+-]{{8}}"),
    Rule("SECRET_ENCRYPTION_KEY", "SEC-ENCRYPTION-KEY", "secret", "EXFILTRATION", "HIGH", "high", 75, rf"(?:ENCRYPTION|encryption)_?(?:KEY|key|SECRET|secret)\s*[=:]\s*{_QUOTE}[A-Za-z0-9/+=:-]{{8}}"),
    Rule("SECRET_API_KEY", "SEC-API-KEY", "secret", "EXFILTRATION", "HIGH", "high", 70, rf"(?:api|API|apikey|API_KEY|api_key)\s*[=:]\s*{_QUOTE}[A-Za-z0-9_-]{{16}}"),
    Rule("DARKNET_ADDRESS", "SEC-DARKNET", "secret", "SUSPICIOUS", "HIGH", "medium", 60, r"[a-zA-Z0-9_-]\.(?:onion|tor)\b"),
    Rule("SECRET_HARDCODED_PASSWORD", "SEC-HARDCODED-PASSWORD", "secret", "EXFILTRATION", "HIGH", "high", 70, rf"(?i)(?:password|passwd|pwd|contrase(?:ñ|Ñ)a)\s*[=:]\s*{_QUOTE}[A-Za-z0-9!@#$%^&*()_+-]{{6}}"),
    Rule("SECRET_HARDCODED_TOKEN", "SEC-HARDCODED-TOKEN", "secret", "EXFILTRATION", "HIGH", "high", 70, rf"(?:token|Token|TOKEN)\s*[=:]\s*{_QUOTE}[A-Za-z0-9_.-]{{16}}"),
    Rule("GYP_COMMAND_SUBSTITUTION", "GYP-SUBSTITUTION", "malware", "MALICIOUS", "CRITICAL", "high", 90, r"['\"]<(?:!@?|@)\("),
    Rule("GYP_DOWNLOADER", "GYP-DOWNLOADER", "malware", "MALICIOUS", "CRITICAL", "high", 90, r"GYP_CMD_|gyp_exec|binding\.gyp.*(?:curl|wget|fetch)"),
    Rule("LIFECYCLE_CURL_BASH", "LIF-CURL-BASH", "malware", "MALICIOUS", "CRITICAL", "high", 90, rf"{_HOOK}\b(?:curl|wget)\b[^\"]*\""),
    Rule("LIFECYCLE_CURL_BASH", "LIF-SHELL", "malware", "MALICIOUS", "CRITICAL", "high", 85, rf"{_HOOK}(?:\b(?:ba)?sh\b|powershell|\.ps1|\b(?:python|node|eval)\b)[^\"]*\""),
    Rule("LIFECYCLE_OBFUSCATED", "LIF-OBFUSCATED", "malware", "MALICIOUS", "CRITICAL", "high", 90, rf"{_HOOK}(?:base64|decode|fromCharCode|chmod \+x|mknod)[^\"]*\""),
    Rule("OBFUSCATED_PAYLOAD", "OBF-PAYLOAD", "malware", "MALICIOUS", "HIGH", "high", 75, r"(?:\\x[0-9a-fA-F]{2}){10}|(?:\\u[0-9a-fA-F]{4}){5}|(?:eval|Function)\([\s\S]{0,100}decode"),
    Rule("WORKFLOW_RISK", "WF-001", "workflow", "VULNERABILITY", "HIGH", "high", 70, r"\bpull_request_target\b"),
    Rule("WORKFLOW_RISK", "WF-002", "workflow", "MALICIOUS", "CRITICAL", "high", 85, r"permissions:\s*write-all|permissions:\s*[>|]\s*\z"),
    Rule("WORKFLOW_RISK", "WF-003", "workflow", "MALICIOUS", "HIGH", "high", 70, r"^\s*contents:\s*write\b"),
    Rule("WORKFLOW_RISK", "WF-004", "workflow", "MALICIOUS", "CRITICAL", "high", 85, r"\.github/workflows/|>\s+/.*\.ya?ml\b"),
    # what is loaded goes into a pipe, or something is run after it
    *[Rule("WORKFLOW_RISK", "WF-005", "workflow", "MALICIOUS", "CRITICAL", "high", 85, p) for load in _LOADERS for p in (rf"^[^#]*{load}\s+\S[^|]*\|", rf"{load}\s+\S.*{_THEN_RUN}")],
    Rule("WORKFLOW_RISK", "WF-006", "workflow", "VULNERABILITY", "HIGH", "high", 65, r"(?i)persist-credentials:\s*(?:true|yes|on)\b"),
    Rule("WORKFLOW_RISK", "WF-007", "workflow", "SUSPICIOUS", "MEDIUM", "high", 40, r"(?:issue|discussion|pull_request_review)_comment:"),
    Rule("AGENT_RISK", "AS-001", "agent", "MALICIOUS", "CRITICAL", "high", 90, phrases(phrase(STOPPING, GUARD), phrase(GUARD, STOPPING))),
    Rule("AGENT_RISK", "AS-002", "agent", "MALICIOUS", "HIGH", "high", 70, phrases(r"file\W*(?:create|delete|modify|write)\W*(?:access|anywhere|permission)", phrase("write", "all any", "directory file path", "no without", "check limit restriction", apart=1))),
    Rule("AGENT_RISK", "AS-003", "agent", "MALICIOUS", "CRITICAL", "high", 90, phrases(
        phrase("run", "all any arbitrary", "command commands"), phrase("execute", "without with-no", "approval asking check review validation", apart=1),
        phrase("do-not don't dont skip", "ask asking check confirmation review validate", "before when", "executing running"), phrase("auto-approve autoapprove", "commands", apart=1),
    )),
    Rule("AGENT_RISK", "AS-004", "agent", "MALICIOUS", "HIGH", "high", 70, phrases(phrase(PUBLISHING, UNSEEN, apart=1))),
    Rule("AGENT_RISK", "AS-005", "agent", "MALICIOUS", "CRITICAL", "high", 90, phrases(phrase("run", "as with", "admin administrator root"), phrase("elevated full-system root-level sudo", RIGHTS))),
    Rule("AGENT_RISK", "AS-006", "agent", "MALICIOUS", "HIGH", "high", 70, phrases(phrase("avoid bypass skip", GATES, apart=1), phrase("merge", "no without", GATES, apart=1))),
    Rule("AGENT_RISK", "AS-007", "agent", "VULNERABILITY", "HIGH", "high", 70, phrases(phrase("mcp", "exec-command filesystem shell-exec write-data write-file", apart=8))),
    Rule("AGENT_RISK", "AS-008", "agent", "MALICIOUS", "CRITICAL", "high", 90, phrases(phrase(WEAKENING, GUARDS, apart=1))),
    Rule("SUBMODULE_POINTER", "DIFF-SUBMODULE", "supply-chain", "VULNERABILITY", "HIGH", "high", 65, r"^Subproject\s+commit\s+[0-9a-fA-F]{40,64}\z"),
    Rule("SUBMODULE_POINTER", "DIFF-SUBMODULE-2", "supply-chain", "VULNERABILITY", "HIGH", "high", 65, r"^Git\s+Submodule\z|^Submodule\s+[0-9a-fA-F]{40,64}.*(?:updated|added|removed)"),
]


def _language(name: str, subcode: str, severity: str, score: int, pattern: str) -> Rule:
    return Rule(subcode, subcode, name, "", severity, "", score, pattern)


# Rules by programming language and the ending of its files.
LANGUAGE_ENDINGS = {"python": ".py", "go": ".go", "rust": ".rs"}
LANGUAGE_RULES = {
    "python": [
        _language("python", "PY-EVAL", "CRITICAL", 80, r"\b(?:eval|exec)\s*\("),
        _language("python", "PY-SUBPROCESS", "HIGH", 60, r"subprocess\.(?:call|Popen)\s*\(|os\.(?:system|popen)\s*\("),
        _language("python", "PY-PICKLE", "HIGH", 55, r"pickle\.loads?\s*\("),
        _language("python", "PY-REQUEST", "MEDIUM", 30, r"requests\.get\s*\(|urllib\.request\.urlopen\s*\("),
        _language("python", "PY-BASE64-EXEC", "CRITICAL", 85, r"(?i)(?:base64|b64decode).*(?:exec|eval)|(?:exec|eval).*(?:base64|b64decode)"),
        _language("python", "PY-IMPORT-FROM", "MEDIUM", 25, r"import\s+from\s+['\"][^'\"]*['\"]\s*\+"),
    ],
    "go": [
        _language("go", "GO-EXEC", "HIGH", 60, r"exec\.Command\s*\("),
        _language("go", "GO-OS-EXEC", "HIGH", 55, r"os\.StartProcess"),
        _language("go", "GO-NET", "MEDIUM", 30, r"net\.Dial\s*\("),
        _language("go", "GO-BASE64-DECODE", "CRITICAL", 85, r"(?i)base64.*(?:exec|command)|(?:exec|command).*base64"),
        _language("go", "GO-UNSAFE", "MEDIUM", 35, r"import\s+[\"']unsafe[\"']"),
    ],
    "rust": [
        _language("rust", "RS-COMMAND", "HIGH", 60, r"Command::new\s*\("),
        _language("rust", "RS-PROCESS", "HIGH", 55, r"std::process::Command"),
        _language("rust", "RS-NET", "MEDIUM", 30, r"TcpStream::connect\s*\("),
        _language("rust", "RS-UNSAFE", "MEDIUM", 40, r"unsafe\s*\{"),
        _language("rust", "RS-BASE64-EXEC", "CRITICAL", 85, r"(?i)base64.*(?:exec|command)|(?:exec|command).*base64"),
    ],
}


class TokenKind(NamedTuple):
    kind: str
    provider: str
    score: int
    confidence: str
    pattern: str


# Token kinds in order of the test.
TOKEN_KINDS = [
    TokenKind("GitHub Fine-grained PAT", "GitHub", 30, "high", r"^github_pat_[0-9a-zA-Z]{22,}\z"),
    TokenKind("GitHub Classic PAT", "GitHub", 60, "high", r"^ghp_[0-9a-zA-Z]{36}\z"),
    TokenKind("GitHub OAuth Access Token", "GitHub", 50, "high", r"^gho_[0-9a-zA-Z]{36}\z"),
    TokenKind("GitHub App Installation Token", "GitHub", 15, "high", r"^ghs_[0-9a-zA-Z]{36}\z"),
    TokenKind("GitHub User-to-Server Token", "GitHub", 35, "high", r"^ghu_[0-9a-zA-Z]{36}\z"),
    TokenKind("AWS Access Key ID", "Amazon Web Services", 80, "high", r"^AKIA[0-9A-Z]{16}\z"),
    TokenKind("Stripe Live Secret Key", "Stripe", 80, "high", r"^sk_live_[0-9a-zA-Z]{24,}\z"),
    TokenKind("Stripe Live Publishable Key", "Stripe", 10, "high", r"^pk_live_[0-9a-zA-Z]{24,}\z"),
    TokenKind("Slack Bot Token", "Slack", 60, "high", r"^xoxb-[0-9a-zA-Z]{10,}\z"),
    TokenKind("Slack App Token", "Slack", 60, "high", r"^xoxa-[0-9a-zA-Z]{10,}\z"),
    TokenKind("Slack User Token", "Slack", 75, "high", r"^xoxp-[0-9a-zA-Z]{10,}\z"),
    TokenKind("SendGrid API Key", "SendGrid", 80, "high", r"^SG\.[A-Za-z0-9_-]{40,}\z"),
    TokenKind("JWT (JSON Web Token)", "Unknown", 45, "medium", r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\z"),
    TokenKind("Generic Secret / API Key", "Unknown", 40, "low", r"^[A-Za-z0-9_.-]{16,}\z"),
]
UNKNOWN_TOKEN = TokenKind("Unknown", "Unknown", 0, "low", "")

# What a permission adds to a token's score, and the least score of each level.
PERMISSION_SCORES = {"repo": 15, "workflow": 10, "admin:org": 20, "contents:write": 15, "pull-requests:write": 10}
TOKEN_LEVELS = [("CRITICAL", 75), ("HIGH", 50), ("MEDIUM", 25), ("LOW", 0)]

# The token in a finding's snippet, by the finding's type.
TOKEN_VALUES = {
    "SECRET_GITHUB_TOKEN": r"gh[opsu]_[0-9a-zA-Z]{36}|github_pat_[0-9a-zA-Z]{22,}",
    "SECRET_AWS_KEY_ID": r"AKIA[0-9A-Z]{16}",
    "SECRET_STRIPE_KEY": r"[sp]k_live_[0-9a-zA-Z]{24,}",
    "SECRET_SENDGRID_KEY": r"SG\.[A-Za-z0-9_-]{40,}",
    "SECRET_SLACK_TOKEN": r"xox[abp]-[0-9a-zA-Z]{10,}",
}

# What a workflow file's content gives its token, as a rule over the whole content.
WORKFLOW_TOKENS = [
    Rule("TOKEN_RISK", "TOK-001", "token", "VULNERABILITY", "HIGH", "high", 75, r"\bcontents:\s*write\b"),
    Rule("TOKEN_RISK", "TOK-002", "token", "VULNERABILITY", "HIGH", "high", 75, r"\bactions:\s*write\b"),
    Rule("TOKEN_RISK", "TOK-003", "token", "VULNERABILITY", "MEDIUM", "high", 50, r"\bpull-requests:\s*write\b"),
    Rule("TOKEN_RISK", "TOK-004", "token", "VULNERABILITY", "HIGH", "high", 80, r"\bpull_request_target\b"),
]

# What a file's name alone gives; the pattern is for its lower-case base name, or for
# the whole path where it holds a slash.
WORKFLOW_PATH = r"\.github[/\\]workflows[/\\].*\.ya?ml\z"
AGENT_FILE = r"^(?:(?:agents|claude|gemini|codex)\.(?:md|txt)|\.cursorrules|\.windsurfrules)\z|\.mdc\z"
NAME_RULES = [
    Rule("SECRET_ENV_FILE", "SEC-ENV-FILE", "secret", "EXFILTRATION", "HIGH", "high", 75, r"^\.env(?:\z|\.)"),
    Rule("SECRET_CREDENTIALS_FILE", "SEC-CREDS-FILE", "secret", "EXFILTRATION", "CRITICAL", "high", 85, r"^(?:credentials\.(?:json|yml)|secrets\.(?:json|yml)|key\.json|service-account\.json)\z"),
    Rule("SECRET_SSH_KEY_FILE", "SEC-SSH-FILE", "secret", "EXFILTRATION", "CRITICAL", "high", 90, r"id_(?:rsa|dsa|ecdsa|ed25519)"),
    Rule("BINDING_GYP", "GYP-FILE", "malware", "MALICIOUS", "HIGH", "high", 70, r"^binding\.gypi?\z"),
    Rule("NODE_GYP_CAPABILITY", "GYP-NODE", "malware", "SUSPICIOUS", "MEDIUM", "medium", 40, r"^node-gyp(?:-build)?\.js\z|\.gyp\z"),
    Rule("WORKFLOW_RISK", "WF-INFO", "workflow", "NEUTRAL", "LOW", "high", 0, WORKFLOW_PATH),
    Rule("AGENT_RISK", "AS-INFO", "agent", "NEUTRAL", "LOW", "high", 0, AGENT_FILE),
]
BINARY_CHANGE = Rule("BINARY_CHANGE", "DIFF-BINARY", "supply-chain", "SUSPICIOUS", "MEDIUM", "medium", 45, r"(?m)^Binary files .* differ$|^GIT binary patch$")
# Findings of whole files, with the least entropy of a script and the least size.
ENTROPY_RULE = Rule("HIGH_ENTROPY", "OBF-ENTROPY", "generic", "MALICIOUS", "HIGH", "medium", 65, r"\.(?:[mc]?js|ts)\z")
SIZE_RULE = Rule("SIZE_ANOMALY", "SIZ-ANOMALY", "generic", "SUSPICIOUS", "MEDIUM", "medium", 30, "")
DENSE_BITS, LARGE_CHARACTERS = 6.0, 500_000

# Multipliers of the agency score by category; others count 1.0.
CATEGORY_WEIGHT = {
    "obfuscation": 1.3,
    "malware": 1.5,
    "ci-cd": 1.2,
    "ci-supply-chain": 1.2,
    "secrets": 1.0,
    "supply-chain": 1.4,
    "injection": 1.2,
    "misconfig": 1.0,
    "ci-evasion": 1.3,
    "agent": 1.3,
    "workflow": 1.2,
    "token": 1.1,
    "generic": 1.0,
}

SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
