"""Rule tables and lists that results depend on."""

# --- fixed values: feature order -------------------------------------------
FEATURES = [
    "energy", "danceability", "valence", "tempo", "acousticness",
    "instrumentalness", "speechiness", "liveness", "key",
]
UNIT_FEATURES = [
    "energy", "danceability", "valence", "acousticness",
    "instrumentalness", "speechiness", "liveness",
]

# --- fixed values: emotion labels and their codes ---------------------------
EMOTION_CODES = {"joy": 0, "sadness": 1, "anger": 2, "fear": 3, "love": 4, "surprise": 5}
EMOTIONS = list(EMOTION_CODES)

# --- fixed values: emotions allowed next to a query emotion -----------------
COMPATIBLE_EMOTIONS = {
    "joy": ["joy", "love", "surprise", "anger"],
    "sadness": ["sadness", "love", "fear"],
    "anger": ["anger", "joy", "fear"],
    "love": ["love", "joy", "sadness"],
    "fear": ["fear", "sadness", "anger"],
    "surprise": ["surprise", "joy"],
}

# --- fixed values: mood rules (emotions, valence range, energy range) -------
MOOD_RULES = {
    "happy": (["joy"], (0.6, 1.0), (0.5, 1.0)),
    "sad": (["sadness"], (0.0, 0.4), (0.0, 0.5)),
    "energetic": (["joy"], (0.5, 1.0), (0.7, 1.0)),
    "calm": ([], (0.4, 0.7), (0.0, 0.4)),
    "angry": (["anger"], (0.0, 0.4), (0.7, 1.0)),
}
CONTEXT_MOODS = {
    "party": "energetic",
    "workout": "energetic",
    "study": "calm",
    "relax": "calm",
    "driving": "happy",
}

# --- fixed values: target profile per label, in FEATURES order --------------
LABEL_PROFILES = {
    "Happy": [0.75, 0.72, 0.85, 120.0, 0.15, 0.05, 0.10, 0.15, 0.45],
    "Sad": [0.30, 0.38, 0.18, 82.0, 0.62, 0.10, 0.05, 0.08, 0.45],
    "Energetic": [0.92, 0.82, 0.75, 142.0, 0.05, 0.03, 0.08, 0.22, 0.45],
    "Calm": [0.22, 0.42, 0.55, 88.0, 0.72, 0.22, 0.04, 0.10, 0.45],
    "Angry": [0.88, 0.55, 0.15, 135.0, 0.08, 0.05, 0.15, 0.28, 0.45],
    "Party": [0.87, 0.88, 0.80, 126.0, 0.08, 0.03, 0.10, 0.30, 0.45],
    "Workout": [0.92, 0.78, 0.70, 142.0, 0.05, 0.03, 0.08, 0.18, 0.45],
    "Study": [0.28, 0.38, 0.50, 95.0, 0.68, 0.42, 0.04, 0.10, 0.45],
    "Relax": [0.18, 0.42, 0.60, 84.0, 0.78, 0.28, 0.03, 0.10, 0.45],
    "Driving": [0.72, 0.65, 0.65, 116.0, 0.18, 0.05, 0.06, 0.15, 0.45],
}

# --- fixed values: picture prompts with their label and label type ----------
PICTURE_PROMPTS = [
    ("a photo of a happy smiling person", "Happy", "mood"),
    ("a photo of a joyful celebration", "Happy", "mood"),
    ("a photo of a sad or crying person", "Sad", "mood"),
    ("a photo of a melancholic scene", "Sad", "mood"),
    ("a photo of an energetic concert or festival", "Energetic", "mood"),
    ("a photo of people jumping or dancing", "Energetic", "mood"),
    ("a peaceful sunset or sunrise landscape", "Calm", "mood"),
    ("a serene nature scene with trees or water", "Calm", "mood"),
    ("a photo of an angry or frustrated person", "Angry", "mood"),
    ("a party scene with dancing people", "Party", "context"),
    ("a nightclub or disco with colorful lights", "Party", "context"),
    ("people working out in a gym", "Workout", "context"),
    ("a person running or jogging outdoors", "Workout", "context"),
    ("a quiet study room or library", "Study", "context"),
    ("a person reading or working at a desk", "Study", "context"),
    ("a relaxing spa or meditation scene", "Relax", "context"),
    ("a cozy living room or bedroom", "Relax", "context"),
    ("a scenic road trip or highway view", "Driving", "context"),
    ("a car interior or driving scene", "Driving", "context"),
]

# --- fixed values: pitch class of a written key root ------------------------
PITCH_CLASSES = {
    "C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6,
    "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11,
}
UNKNOWN_PITCH = 5
SHARP_KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]

# --- fixed values: substrings that mark a non-original version --------------
NON_ORIGINAL_MARKERS = [
    "remix", "remixed", "edit", "version", "ver.", "mix",
    "cover", "covered", "instrumental", "acoustic",
    "live", "live at", "live from", "remaster", "remastered",
    "extended", "radio edit", "club mix", "feat.", "ft.",
    "mashup", "bootleg", "dub", "vip", "flip",
    "(reprise)", "reprise", "karaoke", "tribute", "demo",
]

# --- fixed values: raw column names and their harmonised names --------------
COLUMN_NAMES = {
    "Energy": "energy",
    "Danceability": "danceability",
    "Positiveness": "valence",
    "Tempo": "tempo",
    "Acousticness": "acousticness",
    "Instrumentalness": "instrumentalness",
    "Speechiness": "speechiness",
    "Liveness": "liveness",
    "Loudness (db)": "loudness",
    "Key": "key",
    "Mode": "mode",
    "Artist(s)": "artist",
    "song": "song_name",
    "text": "lyrics",
    "Genre": "genre",
    "Album": "album",
    "Popularity": "popularity",
}
SONG_ALIASES = ["song", "song_name", "name"]
ARTIST_ALIASES = ["Artist(s)", "artist", "artists"]

# --- fixed values: cache lifetimes in seconds, score ranges, limits ---------
TTL_FOUND = 86400
TTL_NOT_FOUND = 300
TTL_ERROR = 30
RELATIVE_RANGE = (0.50, 0.95)
DISTANCE_RANGE = (0.65, 0.98)
EPSILON = 1e-8
TRIPLET_MARGIN = 0.3
HISTORY_LIMITS = (1, 200)
RESULT_LIMITS = (1, 50)
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "webp", "gif"]
IMAGE_MAX_BYTES = 10 * 1024 * 1024
DECADES = [1960, 1970, 1980, 1990, 2000, 2010, 2020]
TAG_NAMES = [
    "Good for Driving", "Good for Yoga/Stretching", "Good for Morning Routine",
    "Good for Social Gatherings", "Good for Work/Study", "Good for Exercise",
    "Good for Relaxation/Meditation", "Good for Party", "Good for Running",
]
