"""Fixed values that results depend on."""

# Reward weights: alignment, readability, rhythm, control, risk.
REWARD_WEIGHTS = {"alignment": 6 / 17, "readability": 3 / 17, "rhythm": 3 / 17, "control": 4 / 17, "risk": 1 / 17}
VISUAL_BALANCE = 0.5
ANCHOR_BALANCE = 0.7
RISK_TERMS = ("absolute", "guaranteed", "cure", "risk-free", "lowest price", "number one", "best")
SEGMENTS = 5
DURATION_SEC = 30.0
WORDS_TARGET, WORDS_MIN, WORDS_MAX = 12, 6, 18
CONTROL_CATEGORIES = ("segment_count", "timestamp_validity", "duration_coverage", "required_fields", "summary_position", "information_density")
FRAME_BINS, FRAMES_PER_BIN, FRAMES_MAX = 8, 2, 16
CANDIDATES = 4
COVERAGE_THRESHOLD = 0.50
CENTRALITY, TEMPERATURE = 0.55, 0.35
METRICS = ("reward", "mv_align", "csr", "semantic_point_coverage", "cider_lite", "rep")
LOWER_IS_BETTER = ("rep",)
PREFIX_METHODS = {"direct": 1, "best_of_4": 4}
BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED = 1000, 42
ROW_TOLERANCE, MATRIX_TOLERANCE, IDENTITY_TOLERANCE = 5e-6, 1e-6, 3e-6
CONTROL_TAGS = ("summary", "salient_point")
SEGMENT_KEYS = ("start", "end", "narration", "on_screen_text", "salient_point", "control_tags")
REFERENCE_PREFIXES = ("Evidence context:", "Expected answer:")
VIDEO_SUFFIXES = ("", ".mp4", ".webm", ".mov", ".mkv", ".avi", ".npz")
WRAPPER_KEYS = ("data", "samples", "annotations", "items", "questions", "qa", "qas")

# Alias lists of annotation fields, in order of precedence.
ALIASES = {
    "video_id": ("video_id", "videoID", "video_uid", "video_name", "video", "id", "uid", "youtube_id", "name"),
    "video_path": ("video_path", "video_file", "video_filename", "path", "filepath", "file", "url", "video_url"),
    "lookup_id": ("videoID", "youtube_id", "video_id", "video_uid", "video_name", "video", "id", "uid", "name"),
    "caption": ("caption", "description", "desc", "summary"),
    "subtitle": ("subtitle", "subtitles", "transcript", "asr", "audio_transcript"),
    "prompt": ("prompt", "instruction", "query", "clue", "evidence"),
    "question": ("question", "query", "problem"),
    "answer": ("answer", "gt_answer", "label", "golden_answer", "correct_answer"),
    "category": ("category", "question_category", "topic_category", "domain", "sub_category", "subfield", "task_type", "type", "video_duration_type"),
    "duration": ("duration", "duration_sec", "video_duration", "length", "duration_seconds"),
    "semantic_points": (
        "semantic_points", "semantic_point", "expected_semantic_points", "evidence_points", "key_points", "key_information", "highlights",
        "clues", "clue", "salient_points", "salient_point", "selling_points", "selling_point", "product_points",
    ),
    "target_audience": ("target_audience", "audience", "user_group"),
    "closing_summary": ("closing_summary", "closing", "conclusion"),
    "choices": ("choices", "candidates", "options"),
    "correct_choice": ("correct_choice", "right_answer", "answer_idx", "answer_index", "correct_idx", "correct_option"),
    "subtitle_text": ("text", "caption", "subtitle", "sentence", "content"),
    "subtitle_start": ("start", "start_time", "from"),
}

# The formal reference manifest: its protocol's name and wording, and the fields that questions, answers and selectors come from.
REFERENCE_PROTOCOL = "official_qa_evidence_and_answer_v2"
REFERENCE_TEMPLATES = ("Evidence context: {official_question}", "Expected answer: {resolved_official_correct_answer}")
REFERENCE_FLAGS = ("reference_enters_generation", "reference_enters_reward", "reference_enters_candidate_selection")
