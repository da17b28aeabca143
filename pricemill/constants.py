"""Fixed values. They must equal the values the results are compared with, so they stand here
as plain text."""

# Sentinel written in place of a missing text value.
MISSING = "missvalue"

# Mean and population standard deviation of log1p(price) on the original training data;
# optional overrides of the values that fit_target() computes.
ORIGINAL_TARGET_MEAN = 2.98081628517
ORIGINAL_TARGET_STD = 0.7459273872548303

# Vocabulary size (index 0 is padding) and sequence lengths.
VOCABULARY_SIZE = 50000
NAME_LENGTH = 10
DESCRIPTION_LENGTH = 85

# Weights by n-gram order for the order-weighted bags.
NAME_NGRAM_WEIGHTS = (2.1385527373939834, 0.3894761681383836)
DESCRIPTION_NGRAM_WEIGHTS = (1.3740067995315037, 1.0248685266832964, 0.7)

# Hash slots of the two vectorisers.
HASH_SLOTS = 2**27
BAG_HASH_SLOTS = 2**28

STOP_WORDS = ("the", "a", "an", "is", "it", "this")

BOILERPLATE_DESCRIPTION = "No description yet"
MISSING_CATEGORY_PATH = "other/other/other"

# Price bounds of a prediction.
PRICE_FLOOR = 3.0
PRICE_CEILING = 2000.0

# Blend weights before they are normalised to sum 1.
BLEND_WEIGHTS = {"embedding": 0.6, "convolution": 0.7, "factorisation": 1.15}

# Snapshot weights, and what their weighted sum is divided by.
SNAPSHOT_WEIGHTS = (0.8, 1.0, 1.2)
SNAPSHOT_DIVISOR = 3.0

# Phrases found in names and what replaces them (first match wins, in this order).
NAME_ALIASES = (
    ("lebron soldier", "lebron_soldier"),
    ("air force", "air_force"),
    ("air forces", "air_force"),
    ("air max", "air_max"),
    ("vs pink", "vs_pink"),
    ("victoria secret", "victoria_'_s_secret"),
    ("victoria secrets", "victoria_'_s_secret"),
    ("v . s .", "victoria_'_s_secret"),
    ("f 21", "forever_21"),
    ("lulu lemon", "lululemon"),
    ("lulu", "lululemon"),
    ("a . e .", "american_eagle"),
)

# Words in names that tell the brand.
BRAND_KEYWORDS = (
    ("lebron_soldier", "nike"),
    ("kyrie", "nike"),
    ("air_force", "nike"),
    ("air_max", "nike"),
    ("vs_pink", "pink"),
    ("vsx", "victoria ' s secret"),
    ("llr", "lularoe"),
    ("ipad", "apple"),
    ("ipod", "apple"),
    ("macbook", "apple"),
    ("iphone", "apple"),
    ("wii", "nintendo"),
    ("gameboy", "nintendo"),
    ("zelda", "nintendo"),
    ("gamecube", "nintendo"),
    ("ae", "american eagle"),
    ("aeo", "american eagle"),
    ("aerie", "american eagle"),
    ("disneyland", "disney"),
    ("minnie", "disney"),
    ("mickey", "disney"),
    ("woody", "disney"),
    ("tsum", "disney"),
)

# Brands that are everyday words and must not be read as a brand inside a name.
COMMON_WORD_BRANDS = ("pink", "express", "guess", "beats", "supreme")

# Appended to a brand that was inferred rather than given.
INFERRED_BRAND_SUFFIX = "2"

# Brands ranked FIRST..LAST by frequency (rank 1 is the sentinel) extend the dictionary.
BRAND_RANK_FIRST = 2
BRAND_RANK_LAST = 200

# Characters of a brand word.
BRAND_WORD = "[a-z0-9*/+\\-'’?!.,|&%®™ôèéü]+"

# Penalties: of the ridge (on the sum of squares), of the sparse linear learner and of the
# factorisation machine with its number of factors and passes; and the search intervals.
RIDGE_ALPHA = 0.4
RIDGE_MAX_ITER = 200
RIDGE_TOLERANCE = 0.01
LINEAR_L1 = 1.4562387067658935e-06
LINEAR_L2 = 0.26754419523908257
LINEAR_L1_RANGE = (0.000001, 0.0001)
LINEAR_L2_RANGE = (0.01, 5.0)
FM_FACTORS = 247
FM_L2 = 0.018493058691917252
FM_INIT = 0.02883106077640207
FM_ITERATIONS = 8
FM_L2_RANGE = (0.005, 0.02)
FM_INIT_RANGE = (0.015, 0.055)
FM_FACTORS_RANGE = (240, 255)

# Least number of train rows of an n-gram, minus one.
NAME_TRAIN_DF = 2
DESCRIPTION_TRAIN_DF = 6

# Our own: size of a step of the factorisation machine, and the rows that a step takes.
FM_STEP = 0.01
FM_BATCH_ROWS = 65536
