"""Parameters of the named queries over the test tables."""

# Fixed values taken from the feature format and its configs.
SEQ_LEN = 512            # feature row length L
PAD_LEN = 640            # longer length that the padding query pads to
MASK_PROB = 0.15         # masking probability
SEED = 123123            # seed of the configs
BATCH = 32               # evaluation batch size
VALID_CUT = 200          # first-n cut on the valid half (5,000 in the configs)

# Choices for the test tables.
VOCAB_SIZE = 2000        # vocabulary words besides the five specials
EXCLUDED_LANG = "es"     # language dropped before the walk
SUPPORTED_LANGS = ("en", "de", "fr")
RANGE_MAX_DEPTH = 16     # range check limits (the test configs' 16 / 16)
RANGE_MAX_SIB = 16
VEC_DIM = 64             # values of a vector of the embeddings table
# rows of each source's vector table, and where it starts in the embeddings table
VEC_ROWS = {"word": VOCAB_SIZE + 5, "type": 1, "position": SEQ_LEN + 2, "depth": SEQ_LEN, "sibling": SEQ_LEN}
VEC_OFFSETS = {"word": 0, "type": 100, "position": 200, "depth": 300, "sibling": 400}
FUSE_WEIGHTS = {"word": 1.0, "type": 0.5, "position": 0.75, "depth": 1.25, "sibling": 1.5}
LN_EPS = 1e-5
N_CLASSES = 64           # logits = all vector values
DOC_DIM = 64             # values of a document vector of the pair classifier
BUCKETS = 8              # buckets of the word vectors' table
EPOCHS = 3               # epochs whose batches are listed
STREAM_FILES = 8         # files that the stream of scored positions arrives in
