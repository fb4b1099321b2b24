"""Fixed values.

Everything in this file is data whose exact content decides results: word lists, file-name
lists, patterns and output texts. Nothing here is logic. Patterns are written for Java regular
expressions; WS stands for the Unicode whitespace class below.
"""

# ---- Fixed values: character classes -------------------------------------------------------
# Characters removed by a Unicode strip and splitting a Unicode word split.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Characters ending a line; "\r\n" counts once.
LINE_BREAK_CHARS = (
    "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029",
)
LINE_BREAK = "\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
# Word characters, for patterns that use a negated class.
ALNUM = r"\p{L}\p{N}"

# ---- Fixed values: languages by file extension ---------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".go": "go",
    ".java": "java",
    ".rb": "ruby",
    ".rs": "rust",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c-header",
    ".cs": "csharp",
    ".md": "markdown",
    ".html": "html",
    ".css": "css",
    ".sh": "shell",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".json": "json",
}
NON_CODE_LANGUAGES = ("yaml", "json", "markdown")

# ---- Fixed values: hard exclusions ---------------------------------------------------------
MERGE_SUBJECT_PREFIX = "merge "
REVERT_SUBJECT = rf'(?iu)^revert[{WS}]+"?[^\n]+?"?[{WS}]*\z'
BOT_AUTHOR = (
    r"bot\n?\z|\[bot\]|github-actions|dependabot|renovate|snyk-bot|greenkeeper|"
    r"semantic-release|codecov|allcontributors|auto-commit|ci-bot"
)
TEXT_EXTENSIONS = (
    ".py", ".js", ".ts", ".go", ".java", ".rb", ".rs", ".cpp", ".c", ".h", ".cs", ".md",
    ".html", ".css", ".sh", ".yml", ".yaml", ".json", ".xml", ".txt", ".sql", ".toml",
    ".ini", ".cfg", ".conf", ".php", ".pl", ".pm", ".kt", ".swift", ".m", ".gradle",
    ".properties", ".bat", ".cmd", ".ps1", ".lock",
)
GENERATED_PATH_PARTS = (
    "package-lock.json", "yarn.lock", "pipfile.lock", "poetry.lock", "go.sum", "cargo.lock",
    ".lock", "__pycache__", ".pyc", "node_modules/", "dist/", "build/",
)
TRIVIAL_SUBJECTS = (".", "-", "fix", "update", "wip", "commit")
WIP_SUBJECT = r"(?iu)^(wip|draft|todo|fixup!|squash!|temp|test commit|debugging)"
VERSION_SUBJECT = (
    rf"(?iu)^(bump|chore\(release\)|release|version)[{WS}:][^\n]*(v?\p{{Nd}}+\.\p{{Nd}}+)"
)
VERSION_FILES = (
    "package.json", "pyproject.toml", "cargo.toml", "setup.py", "pom.xml", "build.gradle",
    "version.txt", "version.py", "setup.cfg",
)
URL_SUBJECT = rf"^https?://[^{WS}]+\z"
TICKET_SUBJECT = r"(?iu)^[a-z]+-\p{Nd}+\z"

# ---- Fixed values: message structure -------------------------------------------------------
TRAILER_PREFIXES = (
    "Change-Id:", "Reviewed-on:", "Reviewed-by:", "Auto-Submit:", "LUCI-TryBot-Result:",
    "Cq-Include-Trybots:", "Commit-Queue:", "Signed-off-by:", "Co-authored-by:", "Closes:",
    "Fixes:", "See:", "Related:", "Refs:", "Cc:", "Acked-by:", "Tested-by:",
    "cherry picked from", "(cherry picked from",
)

# ---- Fixed values: message quality ---------------------------------------------------------
IMPERATIVE_VERBS = (
    "add", "fix", "update", "remove", "refactor", "improve", "change", "implement", "handle",
    "support", "move", "rename", "replace", "clean", "extract", "introduce", "avoid", "prevent",
    "allow", "enable", "disable", "simplify", "optimize", "correct", "resolve", "ensure",
    "revert", "migrate", "deprecate", "bump", "configure", "create", "delete", "make", "use",
    "set", "get", "write", "read", "run", "load", "save", "check", "validate", "verify", "show",
    "hide",
)
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "for", "to", "in", "on", "at",
    "by", "from", "with", "about", "as", "into", "of", "is", "it", "its", "this", "that",
    "these", "those", "are", "was",
)
GENERIC_PHRASES = (
    ("fix", "bug"), ("update", "code"), ("clean", "up"), ("fix", "issue"), ("minor", "fix"),
    ("update", "readme"),
)
SCORE_WEIGHTS = {"verb": 0.3, "informative": 0.3, "aligned": 0.2, "language": 0.2}

# ---- Fixed values: releases ----------------------------------------------------------------
SEMVER_TAG = (
    r"^v?(0|[1-9]\p{Nd}*)\.(0|[1-9]\p{Nd}*)\.(0|[1-9]\p{Nd}*)"
    r"(-(0|[1-9]\p{Nd}*|\p{Nd}*[a-zA-Z-][0-9a-zA-Z-]*)(\.(0|[1-9]\p{Nd}*|\p{Nd}*[a-zA-Z-][0-9a-zA-Z-]*))*)?"
    r"(\+[0-9a-zA-Z-]+(\.[0-9a-zA-Z-]+)*)?\n?\z"
)

# ---- Fixed values: issue numbers -----------------------------------------------------------
ISSUE_CEILING_FACTOR = 3
ISSUE_CEILING_MIN = 5000
ISSUE_CEILING_UNKNOWN = 100000

# ---- Fixed values: external review systems -------------------------------------------------
# (name, text signals, patterns of bot accounts, address of the documentation)
REVIEW_SYSTEMS = (
    (
        "Gerrit",
        (
            "go-review.googlesource.com",
            "chromium-review.googlesource.com",
            "android-review.googlesource.com",
            "gerrit-review.googlesource.com",
            "review.openstack.org",
            "gerrit.",
            "Reviewed-on: https://",
            "Change-Id: I",
        ),
        ("gopherbot", "gerrit-bot", "chromium-bot"),
        "https://gerrit-review.googlesource.com/",
    ),
    (
        "Phabricator",
        ("phabricator", "phab.llvm.org", "differential revision", "D[0-9]+"),
        ("phab-bot", "phabricator-bot"),
        "https://www.phacility.com/phabricator/",
    ),
    (
        "GitLab MR",
        ("gitlab.com/.*/-/merge_requests/", "This PR was opened from a GitLab"),
        ("gitlab-bot",),
        "https://gitlab.com",
    ),
    (
        "Internal Review Tool",
        ("internally reviewed", "reviewed internally", "internal review"),
        (),
        None,
    ),
)
SIGNAL_SHOWN_CHARS = 40
NATIVE_MIN_RATE = 0.15
HIGH_CONFIDENCE_BELOW = 0.05
MEDIUM_CONFIDENCE_BELOW = 0.10

# ---- Fixed values: output texts ------------------------------------------------------------
COMMIT_INSTRUCTION = (
    "You are an expert software engineer. Given a code diff, write a clear and informative commit message.\n"
    "The commit message should:\n"
    "- Start with an imperative verb (Add, Fix, Refactor, Update, Remove, etc.)\n"
    "- Be concise (≤72 chars for the subject line)\n"
    "- Explain *what* changed and *why*, not *how*"
)
COMMIT_CHAT_SYSTEM = (
    "You are an expert software engineer. Given a code diff, write a clear and informative commit message."
)
PATCH_INSTRUCTION = (
    "You are an expert software engineer. Given the issue description and the current state of the relevant file(s), "
    "produce a minimal, correct git patch that resolves the issue."
)
REVIEW_CHAT_SYSTEM = (
    "You are an expert code reviewer. Review the following pull request diff and provide specific, actionable feedback."
)
REVIEW_INSTRUCTION = "Review this pull request diff and provide comments."
NO_DESCRIPTION = "No description provided."
NO_COMMENTS = "No specific comments."
