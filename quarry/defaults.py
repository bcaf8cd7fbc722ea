"""Default parameters whose values must equal the reference pipeline's for equal results.

Fixed values (stated as the reference configures them, in its order):
"""

# --- fixed values: corpus job ---
TARGET_TOKENS = 30_000_000_000  # corpus size goal (reported against, never assumed)
SHARD_TOKENS = 2048 * 1024  # tokens per text shard (2,097,152)
DEDUP_NUM_PERM = 128  # MinHash permutations
DEDUP_THRESHOLD = 0.9  # LSH Jaccard threshold
TEXT_SHARD_NAME = "shard_%05d"  # JSONL text shard name

# --- fixed values: sequence shards ---
SEQ_LENGTH = 2048  # ids per sequence
SEQ_SHARD_SIZE = 1_000_000  # sequences per shard
SEQ_SHARD_NAME = "shard_%06d"  # sequence shard name

# --- fixed values: training data plan ---
BATCH_SIZE = 512
MICRO_BATCH_SIZE = 8
TRAIN_SEQ_LENGTH = 1024
WARMUP_RATIO = 0.05
LOG_INTERVAL = 10
SAVE_INTERVAL = 1000
