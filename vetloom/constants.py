"""Fixed values that results must agree on, kept together in natural order."""

# Classes of the vulnerability classifier; the position is the class index.
CWE_CLASSES = ["CWE-94", "CWE-538", "CWE-89", "CWE-77", "CWE-79", "CWE-352", "CWE-601", "CLEAN"]
CLEAN_INDEX = 7

# Labels that all mean "nothing found".
BENIGN_ALIASES = ["Benign", "benign", "Not Vulnerable", "Normal", "Safe", "0"]

# Label text to number.
STATUS_CODES = {"Vulnerable": 1, "Not Vulnerable": 0, "Error": -1}
CWE_CODES = {
    "Benign": 0,
    "Empty Code": -1,
    "parsing_error": -1,
    "model_error": -1,
    "embedding_error": -1,
    "label_decode_error": -1,
    "analysis_error": -1,
}
CWE_OTHER_CODE = 1
TRAINING_CWE_CODES = {"malicious": 1, "benign": 0}

# Metadata keys that are kept.
METADATA_KEYS = [
    "name",
    "summary",
    "author",
    "author-email",
    "version",
    "maintainer",
    "maintainer-email",
]

# Description thresholds.
SUMMARY_MIN_LENGTH = 10
SUMMARY_MAX_LENGTH = 300
SUMMARY_MIN_ENTROPY = 3.5

# Model input, in order.
PACKAGE_FEATURES = [
    "is_disposable",
    "summary_length",
    "summary_too_short",
    "summary_too_long",
    "summary_entropy",
    "summary_low_entropy",
    "version_valid",
    "is_typo_like",
    "download_log_noisy",
    "vulnerability_status_noisy",
    "threat_level_noisy",
    "cwe_label_noisy",
]

# Leading columns of the comprehensive result.
PRIORITY_COLUMNS = [
    "name",
    "xgboost_prediction",
    "lstm_vulnerability_status",
    "lstm_cwe_label",
    "lstm_confidence",
    "summary",
    "author",
    "author-email",
    "version",
    "download",
    "download_log",
]

# Report sentences: (column, value that triggers the sentence, sentence).
MALICIOUS_REASONS = [
    ("summary_too_short", True, "요약이 너무 짧음"),
    ("summary_too_long", True, "요약이 너무 김"),
    ("summary_low_entropy", True, "요약이 자동 생성된 것으로 의심됨"),
    ("download_too_low", True, "다운로드 수가 비정상적으로 낮음"),
    ("download_too_high", True, "다운로드 수가 비정상적으로 높음"),
    ("version_valid", False, "버전 형식이 올바르지 않음"),
    ("is_disposable", True, "일회용 이메일 사용 의심"),
    ("is_typo_like", True, "인기 패키지 이름과 유사한 오타 기반 이름"),
    ("vulnerability_status_noisy", True, "LSTM 분석에서 취약점 발견"),
]
NORMAL_REASONS = [
    ("summary_too_short", False, "요약 길이 적절함"),
    ("summary_too_long", False, "요약이 너무 길지 않음"),
    ("summary_low_entropy", False, "요약이 사람이 작성한 것으로 보임"),
    ("download_too_low", False, "다운로드 수가 충분함"),
    ("download_too_high", False, "다운로드 수가 과도하지 않음"),
    ("version_valid", True, "버전 형식이 올바름"),
    ("is_disposable", False, "신뢰할 수 있는 이메일 사용"),
    ("is_typo_like", False, "이름이 인기 패키지와 유사하지 않음"),
    ("vulnerability_status_noisy", False, "LSTM 분석에서 취약점 없음"),
]
STATUS_MALICIOUS = "❌ 악성"
STATUS_NORMAL = "✅ 정상"
NO_REASON = "판단 기준 없음"
REPORT_PACKAGE_MARK = "📦"
REPORT_REASON_MARK = "→ 판단 이유: "
REPORT_TITLE = "=== Python 패키지 보안 분석 최종 리포트 ==="
REPORT_TOTAL = "총 분석 패키지 수: {}"
REPORT_MALICIOUS = "악성 패키지: {}개"
REPORT_NORMAL = "정상 패키지: {}개"
REPORT_RATIO = "악성 비율: {}%"

# Python keywords left alone when identifiers are renamed.
PYTHON_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
    "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return",
    "try", "while", "with", "yield",
]

# Upload limits.
MAX_UPLOAD_BYTES = 100 * 1024 * 1024

# Names of the analysis models in the session log.
MODEL_BERT = "Integrated BERT"
MODEL_LSTM = "Integrated LSTM"
MODEL_PACKAGES = "ML (LSTM + XGBoost)"
