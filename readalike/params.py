"""Fixed values that decide the results. Change them and the answers change."""

# Cleaning
MIN_RATING, MAX_RATING = 1, 10
MIN_RATINGS_PER_USER = 3
MIN_RATINGS_PER_BOOK = 5
MIN_YEAR, MAX_YEAR = 1500, 2025
MIN_AGE, MAX_AGE = 13, 100

# Age brackets: first age, last age, label
AGE_BRACKETS = (
    (13, 17, "13-17"),
    (18, 24, "18-24"),
    (25, 34, "25-34"),
    (35, 44, "35-44"),
    (45, 54, "45-54"),
    (55, 100, "55+"),
)

# Item similarity
MIN_COMMON_RATERS = 2
MIN_SIMILARITY = 0.0
CREDIBILITY_QUANTILE = 0.25

# Metadata
FETCH_BATCH_KEYS = 100
FETCH_WAVE_BATCHES = 10
MAX_SUBJECTS = 20
REAL_DESCRIPTION_CHARS = 40

# Vectors
EMBEDDING_DIM = 384

# Recommendation lists
TOP_K = 10
GEM_POOL = 100
FUSION_POOL = 50
EDITION_SPARE = 10
FUSION_ALPHA = 0.6
RRF_CONSTANT = 60
POPULARITY_WEIGHT = 0.3
MIN_CANDIDATE_RATINGS = 8
MIN_BAYESIAN_RATING = 4.5
EDITION_RATIO = 88
SUBJECT_POOL = 200

# Display
DISPLAY_DESCRIPTION_CHARS = 35
DISPLAY_TAGS = 3

# Exploration
FAN_RATING = 7
EXPLORE_MIN_RATINGS = 3
BEST_RATED_MIN_RATINGS = 10
REPORT_ROWS = 10
SIMILARITY_BINS = 80
LOG_EDGES = 70
SAMPLE_ITEMS, SAMPLE_SEED = 6000, 42

# Genre label -> keywords, checked in this order
GENRE_KEYWORDS = (
    ("Fantasy", ("fantasy", "magic", "dragon", "wizard", "tolkien")),
    ("Mystery", ("mystery", "detective", "crime", "thriller", "murder")),
    ("Romance", ("romance", "love", "historical romance")),
    ("Sci-Fi", ("science fiction", "space", "dystopia", "futur")),
    ("Horror", ("horror", "supernatural", "ghost", "vampire")),
    ("History", ("history", "historical", "biography", "memoir")),
)

# Strategy name, label, description, in the order results are listed
STRATEGIES = (
    ("readers_also", "Readers Also Enjoyed",
     "Books that users who read this book also enjoyed"),
    ("hidden_gems", "Hidden Gems",
     "Books that are similar to your seed but have far fewer ratings"),
    ("similar_themes", "Similar Themes and Style",
     "Books with similar descriptions and genres"),
    ("same_author", "More by This Author",
     "Other books by the same author"),
    ("age_group", "Popular With Similar Readers",
     "Top-rated books among the age group that most enjoys your seed book."),
    ("top_picks", "Top Picks For You",
     "Best recommendations combining collaborative and semantic signals."),
)

# Physical limits. They change plans, never results.
HOT_SHARE = 1_000             # a key with more than 1 / this of the rows is joined by broadcast (or 1 / partitions)
RARE_USERS = 500_000          # up to this many users with too few ratings are broadcast
LIGHT_USER_RATINGS = 10_000   # a user above this is paired by the heavy-user route
TAG_PROBES = 4                # of a book's rarest tags, for the first bound of its list
VECTOR_BLOCK_BYTES = 8 << 20   # bytes of vectors per block of the blocked inner product
ENCODE_BATCH_TEXTS = 256      # texts of one call of a supplied encoder
EDGE_BUCKETS = 16             # of the similarity table; about one for 256 MB of it
CACHE_BUCKETS = 64            # folders of the stored metadata cache
SEED_BLOCK_ROWS = 4_096       # seeds of a product with the only block
VECTOR_PIVOTS = 64            # clusters of vectors, where there is more than a block
FEW_SEEDS = 500               # up to this many seeds are broadcast and looked up
TITLE_CHUNK = 4_096           # titles of a posting cell at most
SCAN_QUERIES = 64             # up to this many search texts are broadcast
