"""User-tunable phrase lists and the fixed pattern lists the operators use.

Every operator takes a :class:`CurationConfig`; nothing reads global state.
Patterns are written in JavaScript regex syntax, exactly as the behaviour to
match defines them, and translated for Spark (Java) or RE2 by
``harrow.functions.regex``.  A pattern list means "any of these matches"; all
of them are case-insensitive unless stated otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Example user configuration (phrase lists and the per-source
# cap).  Matching is case-insensitive substring search, deliberately blunt.
# ---------------------------------------------------------------------------
EXAMPLE_JOB_TITLES = (
    "Software Engineer", "Software Developer", "Full Stack Engineer",
    "Full Stack Developer", "Backend Engineer", "Backend Developer",
    "Frontend Engineer", "Frontend Developer", "Product Engineer",
    "Platform Engineer", "Infrastructure Engineer", "Cloud Engineer",
    "DevOps Engineer", "Site Reliability Engineer", "SRE", "Security Engineer",
    "Cybersecurity Analyst", "Data Engineer", "Data Analyst",
    "Business Intelligence Analyst", "BI Analyst", "Analytics Engineer",
    "Solutions Engineer", "Forward Deployed Engineer", "Implementation Engineer",
    "Technical Implementation Engineer", "Product Designer", "UX Designer",
    "UI Designer", "AI Engineer", "ML Engineer", "Machine Learning Engineer",
    "Applied AI Engineer", "Applied ML Engineer", "LLM Engineer",
    "Generative AI Engineer", "AI/ML Engineer", "NLP Engineer",
    "Software Engineer Intern", "Data Analyst Intern", "Security Engineer Intern",
    "Product Design Intern", "AI Engineer Intern", "Machine Learning Intern",
    "Co-op",
)
EXAMPLE_BLOCKED_JOB_TITLES = (
    "Recruiter", "Talent", "HR", "Legal", "Counsel", "Attorney", "Finance",
    "Accounting", "Account Executive", "Sales", "Marketing", "Communications",
    "Customer Support", "Customer Success", "Lead ", " Lead", "Staff",
    "Principal", "Manager", "Director", "Vice President", "Chief ",
)
EXAMPLE_KEYWORDS = (
    "software", "developer", "engineering", "backend", "frontend", "full stack",
    "platform", "infrastructure", "cloud", "devops", "site reliability",
    "security", "cybersecurity", "data", "analytics", "business intelligence",
    "sql", "python", "javascript", "typescript", "react", "node",
    "implementation", "deployment", "ux", "ui", "product design", "LLM",
    "large language model", "GPT", "Claude", "transformer", "fine-tuning", "RAG",
    "retrieval-augmented", "vector database", "embeddings", "PyTorch",
    "TensorFlow", "Hugging Face", "diffusion model", "multimodal",
    "prompt engineering", "agent", "agentic", "langchain", "openai", "anthropic",
)
EXAMPLE_EXCLUDE_KEYWORDS = (
    "10+ years", "10 years experience", "PhD required", "PhD preferred",
    "requires PhD", "security clearance required", "must be US citizen",
    "staff engineer", "principal engineer", "director of", "VP of",
    "vice president",
)
EXAMPLE_PREFERRED_LOCATIONS = (
    "Austin, TX", "Houston, TX", "Remote", "San Francisco, CA", "New York, NY",
    "Seattle, WA", "Boston, MA",
)
EXAMPLE_MAX_JOBS_PER_SOURCE = 50

# ---------------------------------------------------------------------------
# Board title pre-filter phrases (lower-case substrings).
# List A is used for JSON shape A; list B for shapes B and C.
# ---------------------------------------------------------------------------
BOARD_TITLE_PHRASES_A = (
    "machine learning", "ml ", "ai ", "artificial intelligence",
    "deep learning", "nlp", "llm", "data science", "computer vision",
    "research engineer", "applied scientist", "intern", "co-op", "coop",
)
BOARD_TITLE_PHRASES_B = (
    "machine learning", "ml ", " ai ", "artificial intelligence",
    "deep learning", "nlp", "llm", "data science", "computer vision",
    "research engineer", "applied scientist", "research scientist", "intern",
    "co-op", "coop",
)

# ---------------------------------------------------------------------------
# HTML-board relevance patterns (JavaScript syntax, all /i).
# ---------------------------------------------------------------------------
CITY_AI_PATTERNS = (
    r"\bai\b", r"\bml\b", r"machine learning", r"artificial intelligence",
    r"applied ai", r"\bllm\b", r"\bnlp\b", r"generative ai", r"research engineer",
    r"research scientist", r"applied scientist", r"data scientist",
    r"data science", r"computer vision", r"deep learning", r"ai platform",
    r"ai infrastructure", r"\bagi\b", r"robotics", r"autonomy", r"autonomous",
    r"perception", r"dexterous", r"manipulation", r"motion control",
    r"\bintern(ship)?\b", r"\bco-?op\b",
)
CITY_IRRELEVANT_PATTERNS = (
    r"business development", r"\bsales\b", r"marketing", r"\blegal\b",
    r"counsel", r"attorney", r"\bsupport\b", r"customer success",
    r"partnership", r"\brecruit", r"\bproduct manager\b", r"product marketing",
    r"account executive", r"solutions representative", r"event coordinator",
    r"\bfinance\b", r"\bfacilities\b", r"\bsubcontracts\b",
)
STARTUP_AI_PATTERNS = (
    r"\bai\b", r"\bml\b", r"machine learning", r"artificial intelligence",
    r"applied ai", r"\bllm\b", r"\bnlp\b", r"generative ai", r"research engineer",
    r"research scientist", r"applied scientist", r"data scientist",
    r"data science", r"computer vision", r"deep learning", r"ai platform",
    r"ai infrastructure", r"\bagi\b", r"founding ai engineer", r"robotics",
    r"autonomy", r"autonomous", r"perception", r"\bintern(ship)?\b",
    r"\bco-?op\b",
)
STARTUP_IRRELEVANT_PATTERNS = (
    r"business development", r"\bsales\b", r"marketing", r"\blegal\b",
    r"counsel", r"attorney", r"\bsupport\b", r"customer success",
    r"partnership", r"\brecruit", r"\bproduct manager\b", r"product marketing",
    r"account executive", r"former founder", r"head of", r"director of",
    r"\bvp\b", r"vice president",
)
# Intern rows need a second, research-flavoured match (both board kinds).
INTERN_PATTERN = r"\bintern(ship)?\b|\bco-?op\b"
INTERN_ALLOW_PATTERN = (
    r"machine learning|artificial intelligence|applied ai|\bai\b|\bml\b"
    r"|data science|robotics|research|computer vision|perception|autonomy"
    r"|autonomous"
)

# ---------------------------------------------------------------------------
# Classifier patterns (JavaScript syntax, all /i).
# ---------------------------------------------------------------------------
INTERNSHIP_PATTERNS = (
    r"\bintern(ship)?\b", r"\bsummer intern(ship)?\b", r"\bfall intern(ship)?\b",
    r"\bspring intern(ship)?\b", r"\bmachine learning intern(ship)?\b",
    r"\bai intern(ship)?\b", r"\bdata science intern(ship)?\b",
    r"\brobotics intern(ship)?\b", r"\bresearch intern(ship)?\b", r"\bco-?op\b",
    r"\buniversity intern(ship)?\b",
)
FULL_TIME_PATTERNS = (
    r"\bfull[\s-]?time\b", r"\bregular employee\b", r"\bpermanent employee\b",
)
ENTRY_LEVEL_PATTERNS = (
    r"\bentry[\s-]?level\b", r"\bnew grad(uate)?\b", r"\bnew graduate\b",
    r"\buniversity graduate\b", r"\bgraduate program\b", r"\bearly career\b",
    r"\bcampus hire\b",
)
ASSOCIATE_PATTERNS = (
    r"\bassociate (engineer|developer|scientist|researcher|analyst)\b",
    r"\bassociate software engineer\b", r"\bassociate data scientist\b",
)
MID_LEVEL_PATTERNS = (
    r"\bmid[\s-]?level\b", r"\bintermediate\b", r"\b1\+?\s+years?\b",
    r"\b2\+?\s+years?\b", r"\b3\+?\s+years?\b", r"\b1\s*-\s*3\s+years?\b",
    r"\b2\s*-\s*4\s+years?\b",
)
SENIOR_LEVEL_PATTERNS = (r"\bsenior\b", r"\bsr\.?\b", r"\blead\b", r"\bprincipal\b")
STAFF_PLUS_PATTERNS = (
    r"\bstaff\b", r"\bsenior staff\b", r"\bdistinguished\b", r"\barchitect\b",
    r"\bfellow\b",
)

# ---------------------------------------------------------------------------
# Enumerated domains, in display order.
# ---------------------------------------------------------------------------
EMPLOYMENT_TYPES = ("Internship", "Full-Time", "Unknown")
EXPERIENCE_LEVELS = (
    "Internship", "Entry Level", "Associate", "Mid Level", "Senior", "Staff+",
    "Unknown",
)
STATUSES = ("New", "Reviewing", "Apply", "Applied", "Interviewing", "Rejected", "Offer")

# ---------------------------------------------------------------------------
# Salary text patterns (JavaScript syntax).  Hourly and range
# are case-insensitive; the single-amount pattern is case-sensitive.
# ---------------------------------------------------------------------------
SALARY_HOURLY_PATTERN = r"\$[\d,]+(?:\s*[-–]\s*\$[\d,]+)?\s*\/\s*hr"
SALARY_RANGE_PATTERN = r"(\$[\d,]+(?:K)?)\s*[-–]\s*(\$[\d,]+(?:K)?)"
SALARY_SINGLE_PATTERN = r"\$[\d,]+(?:K)?"
SALARY_DASH_PATTERN = r"\s*[-–]\s*"
NOT_LISTED = "Not listed"

# ---------------------------------------------------------------------------
# Company text patterns (JavaScript syntax).
# ---------------------------------------------------------------------------
BATCH_SUFFIX_PATTERN = r"\s+\([A-Z]\d+\)\s*$"  # /i
HEADING_COMPANY_PATTERN = r"\sat\s(.+?)(?:\s\([A-Z]\d+\))?$"  # case-sensitive

# ---------------------------------------------------------------------------
# Date repair.
# ---------------------------------------------------------------------------
KNOWN_BAD_FALLBACK_DATE = "2026-04-14"
NOT_POSTED = "Not Posted"

# ---------------------------------------------------------------------------
# Source registry (label, enabled) in run order, and the board
# dimensions of the JSON sources as (company name, token) in board order.
# ---------------------------------------------------------------------------
SOURCES = (
    ("Wellfound", False), ("Greenhouse", True), ("Lever", True), ("Ashby", True),
    ("BuiltIn Austin", True), ("BuiltIn Houston", True), ("YC Jobs", True),
)
# Seed pages of the HTML sources, in their order.
SEEDS = {
    "BuiltIn Austin": ("https://builtin.com/jobs/austin/machine-learning",
                       "https://builtin.com/jobs/austin/artificial-intelligence"),
    "BuiltIn Houston": ("https://builtin.com/jobs/texas/machine-learning",
                        "https://builtin.com/jobs/texas/artificial-intelligence"),
    "YC Jobs": ("https://www.workatastartup.com/jobs?role=ml-engineer&q=",
                "https://www.workatastartup.com/jobs?q=machine+learning+engineer",
                "https://www.workatastartup.com/jobs?q=AI+engineer"),
}
BOARDS_A = (
    ("Anthropic", "anthropic"), ("Scale AI", "scaleai"), ("Waymo", "waymo"),
    ("Databricks", "databricks"), ("Cohere", "cohere"), ("Character.AI", "character"),
    ("ElevenLabs", "elevenlabs"), ("Runway", "runwayml"), ("Aurora", "aurora"),
    ("Recursion", "recursionpharma"), ("Nauto", "nauto"), ("Insitro", "insitro"),
    ("Imbue", "imbue"), ("Cognition", "cognition"), ("Harvey AI", "harvey"),
)
BOARDS_B = (
    ("Mistral AI", "mistral"), ("Palantir", "palantir"), ("Spotify", "spotify"),
    ("Zoox", "zoox"), ("Hive AI", "hive"), ("Level AI", "levelai"),
    ("SonarSource", "sonarsource"), ("CI&T", "ciandt"),
    ("Toyota Research Inst", "tri"), ("Field AI", "field-ai"),
    ("Fullscript", "fullscript"), ("IMO Health", "imo-online"),
    ("Aera Technology", "aeratechnology"), ("WeRide", "weride"),
    ("Anyscale", "anyscale"),
)
BOARDS_C = (
    ("OpenAI", "openai"), ("Harvey AI", "harvey"), ("Sierra AI", "sierra"),
    ("Cohere", "cohere"), ("Cursor", "cursor"), ("Perplexity AI", "perplexity"),
    ("Synthesia", "synthesia"), ("Cognition", "cognition"), ("Writer", "writer"),
    ("Replit", "replit"), ("Lambda", "lambda"), ("Modal", "modal"),
    ("Character AI", "character"), ("LlamaIndex", "llamaindex"), ("Pika Labs", "pika"),
)
# Fallback URL templates: prefix + token + "/" + [jobs/] + id.
URL_TEMPLATE_A = "https://boards.greenhouse.io/{token}/jobs/{id}"
URL_TEMPLATE_B = "https://jobs.lever.co/{token}/{id}"
URL_TEMPLATE_C = "https://jobs.ashbyhq.com/{token}/{id}"
# Default location per HTML source: (no card on page, card without location).
HTML_LOCATION_DEFAULTS = {
    "BuiltIn Austin": ("Austin, TX", "Austin, TX"),
    "BuiltIn Houston": ("Houston, TX", "Texas"),
    "YC Jobs": ("Remote", "Remote"),
}
# Location-like leaf text on city-board cards (JavaScript syntax, /i).
CITY_LOCATION_PATTERNS = {
    "BuiltIn Austin": r"remote|hybrid|in.office|TX|Austin",
    "BuiltIn Houston": r"remote|hybrid|in.office|TX|Houston|Texas",
}
# Store-repair host routing: URL substring -> recovery rule.
HOST_RULE_HEADING_LINE = "builtin.com"
HOST_RULE_HEADING_AT = "workatastartup.com"


@dataclass(frozen=True)
class CurationConfig:
    """The user-facing knobs: phrase lists for the four tiers and the cap."""

    job_titles: tuple[str, ...] = EXAMPLE_JOB_TITLES
    blocked_job_titles: tuple[str, ...] = EXAMPLE_BLOCKED_JOB_TITLES
    keywords: tuple[str, ...] = EXAMPLE_KEYWORDS
    exclude_keywords: tuple[str, ...] = EXAMPLE_EXCLUDE_KEYWORDS
    preferred_locations: tuple[str, ...] = EXAMPLE_PREFERRED_LOCATIONS
    max_jobs_per_source: int | None = EXAMPLE_MAX_JOBS_PER_SOURCE
    skip_unreadable: bool = False  # read past files that cannot be read; collect_run reports them
    extra: dict = field(default_factory=dict)

    def with_(self, **changes) -> "CurationConfig":
        return replace(self, **changes)
