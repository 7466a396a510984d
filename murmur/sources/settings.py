"""Constants of the analysis; fixed values, grouped by their use."""

WEIGHT_LIKES, WEIGHT_COMMENTS, WEIGHT_SHARES = 1, 3, 5
DAY_MS = 86_400_000
MATURE_DAYS, PROVISIONAL_DAYS = 3, 1
LEVEL_POSTS, LEVEL_DAYS, LEVEL_LEAST = 10, 60, 5
SPREAD_DAYS, SPREAD_LEAST, RESIDUALS_LEAST = 180, 15, 8
SPREAD_FLOOR, MAD_SCALE = 0.15, 1.4826
RARE_Z, NOTABLE_Z, LOW_Z = 2.5, 1.5, -1.5
IMAGE_SIMILAR, CONTENT_SIMILAR, CONTENT_FLOOR = 0.8, 0.65, 0.60
TEXT_WEIGHT, IMAGE_WEIGHT, GROUP_LEAST, CANDIDATES = 0.75, 0.25, 2, 400
RETRIEVED, RRF_K = 500, 60
FOLLOWER_FLOOR, STALE_DAYS, APPROX_FACTOR = 10_000, 2, 1.5
CLIMBING_PERCENT, SLOT_DAYS = 5, 0.5
TIMEFRAMES = {"24h": 1, "3d": 3, "week": 7, "month": 30, "3months": 90}
PLATFORMS = ("linkedin", "twitter", "substack", "instagram")
#: Domains of the platforms (fixed values); functions over urls take others as parameters.
SITES = {"linkedin": ("linkedin.com",), "twitter": ("twitter.com", "x.com"), "substack": ("substack.com",), "instagram": ("instagram.com",)}
#: Image hosts whose files are proxied (fixed values).
PROXIED = ("cdninstagram.com", "fbcdn.net", "licdn.com")
#: Those that stand for them in the test tables.
TEST_SITES = {"linkedin": ("links.example",), "twitter": ("chirp.example",), "substack": ("letters.example",), "instagram": ("pics.example",)}
NOVELTY_POSTED, NOVELTY_COVERED, REFRESH_DAYS = 0.85, 0.65, 30
DRAFT_DAYS, DRAFT_SIMILAR = 10, 0.55
PAGE, PAGE_MOST = 50, 200
#: The instant that stands for now in registered queries.
NOW = "2026-06-30 00:00:00"
NOW_MS = 1_782_777_600_000
