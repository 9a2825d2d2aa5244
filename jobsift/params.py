"""Run parameters and the fixed lookup values of the posting pipeline.

Configuration is small and lives on the driver: roles, boards, locations and
work types are turned into literal columns or tiny DataFrames, never collected
from data. Everything that grows with the data stays in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original tool's values for the scores,
# labels and parses to agree; they are stated here as plain text.
# ---------------------------------------------------------------------------

WORK_TYPES = ["remote", "hybrid", "onsite"]
EMPLOYMENT_TYPES = ["full-time", "part-time", "contract", "temporary"]
STATUSES = ["pending", "skipped"]

SENIORITY_ORDER = ["junior", "mid", "senior", "staff", "principal"]

# Title -> level; the first matching pattern wins (lower-cased title).
SENIORITY_PATTERNS = [
    (r"\b(junior|jr\.?|entry.?level|associate)\b", "junior"),
    (r"\b(mid|intermediate|mid.?level)\b", "mid"),
    (r"\b(senior|sr\.?)\b", "senior"),
    (r"\bstaff\b", "staff"),
    (r"\b(principal|distinguished|fellow|director|vp)\b", "principal"),
]

# Required-years phrasings in a lower-cased description; the maximum wins.
YEARS_RANGE_PATTERN = r"(\d+)\s*(?:to|-)\s*(\d+)\s*years?"
YEARS_PLUS_PATTERN = r"(\d+)\+\s*years?"
YEARS_EXPERIENCE_PATTERN = r"(\d+)\s*years?\s+(?:of\s+)?(?:[\w-]+\s+){0,2}(?:experience|exp)"

SENIORITY_IN_RANGE_BONUS = 8
SENIORITY_STEP_PENALTY = 10
SENIORITY_MAX_PENALTY = 20
EXPERIENCE_MAX_PENALTY = 20
HOURS_PER_YEAR = 2080

# Extra engineering words accepted by the startup board's title relevance test.
ENG_KEYWORDS = [
    "software", "engineer", "developer", "backend", "frontend", "full stack",
    "fullstack", "swe", "sde", "platform", "infrastructure", "devops", "ml",
    "machine learning", "data",
]

# Staffing board worksite and employment-type labels (first containing key wins).
WORKSITE_MAP = [("remote", "remote"), ("hybrid", "hybrid"), ("onsite", "onsite")]
EMPLOYMENT_TYPE_MAP = [
    ("permanent / full time", "full-time"),
    ("full time", "full-time"),
    ("contract to hire", "contract"),
    ("contract", "contract"),
    ("temporary to hire", "temporary"),
    ("temporary", "temporary"),
    ("part time", "part-time"),
    ("part-time", "part-time"),
]

# US state code -> name (the listing board takes the name as a search parameter).
STATE_NAMES = [
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"),
    ("CA", "California"), ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"),
    ("FL", "Florida"), ("GA", "Georgia"), ("HI", "Hawaii"), ("ID", "Idaho"),
    ("IL", "Illinois"), ("IN", "Indiana"), ("IA", "Iowa"), ("KS", "Kansas"),
    ("KY", "Kentucky"), ("LA", "Louisiana"), ("ME", "Maine"), ("MD", "Maryland"),
    ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"), ("MS", "Mississippi"),
    ("MO", "Missouri"), ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"),
    ("NH", "New Hampshire"), ("NJ", "New Jersey"), ("NM", "New Mexico"), ("NY", "New York"),
    ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"), ("OK", "Oklahoma"),
    ("OR", "Oregon"), ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"),
    ("SD", "South Dakota"), ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"),
    ("VT", "Vermont"), ("VA", "Virginia"), ("WA", "Washington"), ("WV", "West Virginia"),
    ("WI", "Wisconsin"), ("WY", "Wyoming"), ("DC", "District of Columbia"),
]

# Relative-age dialects: units each board understands and whether "ago" is required.
RELATIVE_DIALECTS = {
    "linkedin": (["minute", "hour", "day", "week"], True),
    "wellfound": (["minute", "hour", "day", "week"], False),
    "builtin": (["minute", "hour", "day"], True),
    "workatastartup": (["minute", "hour", "day", "week", "month"], False),
}
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}

# Board registry order, base URLs used to absolutise relative links.
BOARD_NAMES = [
    "linkedin", "wellfound", "builtin", "remotive", "weworkremotely",
    "arbeitnow", "workatastartup", "roberthalf", "greenhouse",
]
BOARD_BASE_URLS = {
    "linkedin": "https://www.linkedin.com",
    "wellfound": "https://wellfound.com",
    "builtin": "https://builtin.com",
    "workatastartup": "https://www.workatastartup.com",
}
LOCATION_BLIND_BOARDS = ["remotive", "weworkremotely", "arbeitnow"]
# Boards whose posting work type is only what the posting says (no fallback
# to the requested work type of the search).
NO_FALLBACK_WORK_TYPE_BOARDS = ["arbeitnow", "workatastartup"]
GLOBAL_SEARCH_BOARDS = ["workatastartup"]

DESCRIPTION_ANALYSIS_CHARS = 4000
DESCRIPTION_LETTER_CHARS = 3000
CARD_DESCRIPTION_CHARS = 2000
NOTES_DISPLAY_CHARS = 60

# Job-id patterns per board (first capture group is the id).
JOB_ID_PATTERNS = {
    "linkedin": r"/jobs/view/(\d+)",
    "wellfound": r"/jobs/(\d+)",
    "workatastartup": r"/jobs/(\d+)",
    "builtin": r"/jobs/(\d+|[a-z0-9-]+)/?$",
}

CSV_FIELDS = ["title", "company", "location", "source", "url", "posted_at", "work_type",
              "match_score", "status", "notes"]


# ---------------------------------------------------------------------------
# Configuration records (driver-side, bounded by what a user configures).
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Role:
    role_id: int
    title: str
    levels: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    years_experience: float = 3.0
    experience_std_dev: float = 2.0
    resume_path: Optional[str] = None

    @property
    def level_bounds(self) -> tuple[Optional[int], Optional[int]]:
        idx = [SENIORITY_ORDER.index(lv) for lv in self.levels if lv in SENIORITY_ORDER]
        return (min(idx), max(idx)) if idx else (None, None)

    @property
    def terms(self) -> list[str]:
        return [self.title.lower()] + [k.lower() for k in self.keywords]


@dataclass(frozen=True)
class Board:
    name: str
    enabled: bool = True
    board_tokens: tuple[str, ...] = ()


@dataclass(frozen=True)
class Location:
    city: str
    state: str = ""
    country: str = "US"
    radius_miles: int = 25

    def label(self) -> str:
        return f"{self.city}, {self.state}"


@dataclass(frozen=True)
class SalaryParams:
    min: Optional[int] = None
    max: Optional[int] = None
    currency: str = "USD"
    skip_if_below_min: bool = True
    include_unlisted: bool = True


@dataclass(frozen=True)
class RunParams:
    max_jobs: int = 10
    max_jobs_per_location: int = 25
    posted_within_hours: float = 1.0
    min_match_score: int = 65
    cover_letter: bool = True
    employment_types: tuple[str, ...] = ("full-time",)
    salary: SalaryParams = field(default_factory=SalaryParams)
    company_blacklist: tuple[str, ...] = ()
    # One evaluation instant for the whole run (the original reads the clock per row).
    run_ts: str = "2024-01-31 00:00:00"

    @property
    def blacklist_terms(self) -> list[str]:
        # Blank entries would match every company; they are ignored.
        return [b.lower() for b in self.company_blacklist if b.strip()]


@dataclass(frozen=True)
class SearchConfig:
    roles: tuple[Role, ...]
    boards: tuple[Board, ...]
    locations: tuple[Location, ...]
    work_types: tuple[str, ...] = ("hybrid",)
    run: RunParams = field(default_factory=RunParams)
    contact_name: str = ""
    contact_email: str = ""

    @property
    def enabled_boards(self) -> list[Board]:
        return [b for b in self.boards if b.enabled and b.name in BOARD_NAMES]

    def board_ord(self) -> dict[str, int]:
        return {b.name: i for i, b in enumerate(self.enabled_boards)}

    def role(self, role_id: int) -> Role:
        return next(r for r in self.roles if r.role_id == role_id)
