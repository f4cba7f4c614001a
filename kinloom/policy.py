"""Weights, caps, thresholds and word lists that the operators share."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on them as they stand.
SOURCES = ("github", "stackoverflow", "devto", "hackernews")

WEIGHTS = {
    "input_handle_match": "0.25",
    "exact_name_match": "0.20",
    "partial_name_match": "0.10",
    "email_hint_match": "0.35",
    "email_domain_match": "0.12",
    "same_website": "0.30",
    "direct_profile_link": "0.40",
    "reciprocal_profile_link": "0.45",
    "similar_handle": "0.12",
    "same_location": "0.08",
    "location_overlap": "0.05",
    "bio_keyword_overlap": "0.08",
    "topic_overlap": "0.12",
}
GROUPS = {
    "input_handle_match": "input_identifier",
    "exact_name_match": "name",
    "partial_name_match": "name",
    "email_hint_match": "email",
    "email_domain_match": "email",
    "same_website": "website",
    "direct_profile_link": "profile_link",
    "reciprocal_profile_link": "profile_link",
    "similar_handle": "handle",
    "same_location": "location",
    "location_overlap": "location",
    "bio_keyword_overlap": "bio",
    "topic_overlap": "topics",
}
CAPS = {"input_identifier": "0.25", "name": "0.20", "website": "0.30", "profile_link": "0.45", "handle": "0.12", "email": "0.35", "location": "0.08", "bio": "0.08", "topics": "0.12"}
STRONG_ACCOUNT_GROUPS = ("input_identifier", "email")
STRONG_PAIR_GROUPS = ("website", "profile_link", "email")
WEAK_GROUPS = ("handle", "location", "bio", "topics")
WEAK_SIGNALS = ("partial_name_match", "similar_handle", "same_location", "location_overlap", "bio_keyword_overlap", "topic_overlap")
REJECT_CONFLICTS = ("email_conflict", "name_conflict", "website_conflict")
PENALTIES = {"name_conflict": ("high", "-0.25"), "website_conflict": ("low", "-0.05"), "location_conflict": ("low", "-0.10"), "email_hash": ("high", "-0.35"), "email_domain": ("medium", "-0.12"), "topic_mismatch": ("low", "-0.05")}
SOURCE_PRIORITY = {"github": 100, "stackoverflow": 85, "devto": 75, "hackernews": 35}
NAME_PRIORITY = {"github": 100, "devto": 85, "stackoverflow": 80, "hackernews": 20}
BIO_PRIORITY = {"github": 100, "devto": 90, "stackoverflow": 75, "hackernews": 25}
AVATAR_PRIORITY = {"github": 100, "devto": 80, "stackoverflow": 75, "hackernews": 10}
RELATIONSHIP_PRIORITY = {"primary": 100, "secondary": 80, "possible_alias": 30, "rejected": 0}

NAME_TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir")
WEAK_NAMES = ("john", "mike", "michael", "david", "james", "robert", "daniel", "paul", "mark", "alex", "sam", "mohammed", "muhammed", "muhammad", "ali", "khan", "singh", "patel")
PLATFORM_DOMAINS = (
    "github.com", "www.github.com", "dev.to", "www.dev.to", "stackoverflow.com", "www.stackoverflow.com", "news.ycombinator.com", "hn.algolia.com",
    "linkedin.com", "www.linkedin.com", "twitter.com", "x.com", "www.twitter.com", "www.x.com",
)
SHARED_DOMAINS = ("medium.com", "substack.com", "hashnode.dev", "about.me", "linktr.ee", "bio.link", "notion.site", "vercel.app", "netlify.app", "pages.dev")
GENERIC_EMAIL_DOMAINS = ("gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "me.com", "proton.me", "protonmail.com", "pm.me")
GENERIC_TOPICS = (
    "app", "apps", "api", "apis", "backend", "code", "coding", "dev", "developer", "development", "engineer", "engineering", "frontend", "fullstack",
    "open-source", "opensource", "programmer", "programming", "project", "projects", "software", "tech", "technology", "tutorial", "tutorials", "web",
)
VAGUE_LOCATIONS = ("earth", "world", "worldwide", "internet", "remote", "online", "global", "somewhere", "everywhere", "localhost")
LOCATION_ALIASES = {
    "bengaluru": "bangalore", "bangaluru": "bangalore", "blr": "bangalore", "nyc": "new york", "sf": "san francisco", "sfo": "san francisco",
    "bay area": "san francisco bay area", "usa": "united states", "us": "united states", "u s": "united states", "u s a": "united states",
    "united states of america": "united states", "uk": "united kingdom", "u k": "united kingdom", "great britain": "united kingdom",
    "uae": "united arab emirates", "u a e": "united arab emirates",
}
TOPIC_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you", "your")
BIO_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "that", "the", "this", "to",
    "with", "you", "your", "about", "also", "build", "building", "built", "code", "coder", "coding", "creator", "developer", "developers", "engineer",
    "engineering", "enthusiast", "expert", "fan", "founder", "hacker", "maker", "open", "person", "software", "source", "stuff", "tools", "work", "working",
    "writes", "writing",
)
BIO_SHORT = ("ai", "ar", "bi", "ci", "cd", "db", "dl", "dx", "js", "ml", "nlp", "qa", "rl", "ts", "ui", "ux", "vr", "xr")
BIO_PHRASES = {
    r"\bartificial\s+intelligence\b": "ai", r"\bmachine\s+learning\b": "ml", r"\bdeep\s+learning\b": "dl", r"\bnatural\s+language\s+processing\b": "nlp",
    r"\blarge\s+language\s+models?\b": "llm", r"\buser\s+interface\b": "ui", r"\buser\s+experience\b": "ux", r"\bcontinuous\s+integration\b": "ci",
    r"\bcontinuous\s+deployment\b": "cd",
}
BIO_ALIASES = {
    "amazonwebservices": "aws", "aws": "aws", "back-end": "backend", "backend": "backend", "backends": "backend", "c#": "csharp", "c++": "cpp",
    "dev-ops": "devops", "devops": "devops", "dockerized": "docker", "fast-api": "fastapi", "front-end": "frontend", "frontend": "frontend",
    "frontends": "frontend", "gen-ai": "genai", "generative-ai": "genai", "golang": "golang", "graphql": "graphql", "java-script": "javascript",
    "javascript": "javascript", "js": "javascript", "k8s": "kubernetes", "kubernetes": "kubernetes", "llms": "llm", "next.js": "nextjs", "nextjs": "nextjs",
    "node.js": "nodejs", "nodejs": "nodejs", "postgresql": "postgres", "react.js": "react", "reactjs": "react", "tailwind-css": "tailwind",
    "typescript": "typescript", "ts": "typescript",
}
TRACKING_PARAMS = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src")
SECRET_PARAMS = ("key", "token", "access_token", "client_secret", "api_key")
RETRY_STATUSES = (408, 429, 500, 502, 503, 504)
# Failures of model calls, accepted links, words of messages that aren't shown, weak texts: fixed values.
FATAL_STATUSES = (400, 401, 403, 404)
TRANSIENT_STATUSES = (429, 500, 502, 503, 504)
FATAL_MARKERS = ("api key not valid", "invalid api key", "permission denied", "unauthenticated", "invalid argument", "bad request", "forbidden", "safety", "blocked")
TRANSIENT_MARKERS = ("resource_exhausted", "rate limit", "quota", "too many requests", "temporarily unavailable", "unavailable", "deadline exceeded", "timeout", "timed out", "internal", "server error")
ACCEPTED_RELATIONSHIPS = ("primary", "alias", "secondary")
ACCEPTED_VERIFICATIONS = ("claimed_by_input", "evidence_matched", "reciprocal_link_verified")
SENSITIVE_MESSAGE = "raw_payload|access[_-]?token|api[_-]?key|authorization|secret|password|email"
GENERIC_BIOS = ("developer", "software developer", "software engineer", "programmer", "coder", "student", "engineer")
GENERIC_SKILLS = ("software", "developer", "development", "programming", "code", "coding", "technology", "tech", "web", "app", "apps", "project", "projects", "personal", "portfolio")
SKILL_FIELDS = ("topics", "skills", "tags", "languages")
SKILL_KEYS = ("topics", "skills", "tags", "languages", "top_languages", "repo_topics", "article_tags")
WEAK_HEADLINES = ("hello", "hi", "welcome", "welcome to my profile", "developer", "software developer", "software engineer", "programmer", "coder")
SECONDARY_RECORDS = {"github": ("repos",), "stackoverflow": ("answers", "questions"), "devto": ("articles",), "hackernews": ("activity",)}
RESERVED_PATHS = {
    "github": (
        "about", "apps", "collections", "customer-stories", "events", "explore", "features", "issues", "login", "marketplace", "new", "notifications", "orgs",
        "pricing", "pulls", "readme", "search", "settings", "sponsors", "topics", "trending",
    ),
    "devto": (
        "about", "api", "code-of-conduct", "contact", "dashboard", "enter", "listings", "new", "pod", "podcasts", "privacy", "search", "settings", "shop",
        "signin", "tag", "tags", "t", "terms", "top", "videos",
    ),
}
IDENTIFIER_PATTERNS = {"github": r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?$", "devto": r"^[A-Za-z0-9][A-Za-z0-9_-]{0,49}$", "hackernews": r"^[A-Za-z0-9_-]{1,100}$", "stackoverflow": r"^\d+$"}
RATE_LIMITS = {"devto": (10, 30), "hackernews": (30, 60)}


@dataclass(frozen=True)
class Policy:
    """Thresholds of the decisions; the defaults are the fixed ones."""

    auto_match: str = "0.85"
    needs_review: str = "0.60"
    least_groups: int = 2
    confidence_cap: str = "0.97"
    penalty_floor: str = "-0.95"
    review_low: str = "0.55"
    review_high: str = "0.84"
    review_least: str = "0.72"
    per_source: int = 3
    per_request: int = 12


DEFAULT = Policy()
