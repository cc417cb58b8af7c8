"""Fixed values of the data model and of the scoring rules."""

# ---- fixed values: feature columns ----
NUMERIC_FEATURES = [
    "bpm", "popularity", "loudness", "acousticness", "danceability", "energy",
    "instrumentalness", "liveness", "speechiness", "valence",
]
CATEGORICAL_FEATURES = ["key", "mode", "camelot"]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
DESCRIPTIVE = ["track_id", "track_name", "artist_names", "album_name", "album_image_url"]
# Features whose absence puts a track on the refresh list.
REFRESH_FEATURES = [
    "popularity", "loudness", "acousticness", "danceability", "energy",
    "instrumentalness", "liveness", "speechiness", "valence",
]

# ---- fixed values: note name -> pitch class, as used by similarity search ----
SEARCH_PITCH = {
    "C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6,
    "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11,
}

# ---- fixed values: key tables of the enrichment step ----
PITCH_CLASS = {
    "C": 0, "B#": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "Fb": 4, "F": 5, "E#": 5,
    "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11, "Cb": 11,
}
CAMELOT_MINOR = {
    "Ab": "1A", "G#": "1A", "Eb": "2A", "D#": "2A", "Bb": "3A", "A#": "3A", "F": "4A", "C": "5A",
    "B#": "5A", "G": "6A", "D": "7A", "A": "8A", "E": "9A", "Fb": "9A", "B": "10A", "Cb": "10A",
    "F#": "11A", "Gb": "11A", "C#": "12A", "Db": "12A",
}
CAMELOT_MAJOR = {
    "B": "1B", "Cb": "1B", "F#": "2B", "Gb": "2B", "Db": "3B", "C#": "3B", "Ab": "4B", "G#": "4B",
    "Eb": "5B", "D#": "5B", "Bb": "6B", "A#": "6B", "F": "7B", "E#": "7B", "C": "8B", "B#": "8B",
    "G": "9B", "D": "10B", "A": "11B", "E": "12B", "Fb": "12B",
}
FLAT_TO_SHARP = {"Bb": "A#", "Eb": "D#", "Ab": "G#", "Db": "C#", "Gb": "F#"}

# ---- fixed values: mood rules, five (feature, low, high) ranges each ----
MOODS = {
    "study": [("energy", 0, 45), ("instrumentalness", 60, 100), ("speechiness", 0, 20),
              ("acousticness", 40, 100), ("valence", 40, 60)],
    "workout": [("energy", 75, 100), ("danceability", 70, 100), ("bpm", 120, 180),
                ("loudness", 70, 100), ("valence", 50, 100)],
    "sleep": [("energy", 0, 30), ("bpm", 0, 80), ("loudness", 0, 60),
              ("instrumentalness", 70, 100), ("valence", 0, 50)],
    "party": [("energy", 75, 100), ("danceability", 70, 100), ("valence", 65, 100),
              ("popularity", 70, 100), ("loudness", 70, 100)],
}
STRONG_MATCH = 0.72
STRONG_MINIMUM = 3
CANDIDATE_POOL = 9
CANDIDATE_SAMPLE = 3
COSINE_WEIGHT, MOOD_WEIGHT = 0.72, 0.28
PLAYLIST_MIN, PLAYLIST_MAX, PLAYLIST_DEFAULT = 5, 100, 20

# ---- fixed values: clustering sweep ----
SWEEP_MAX_K = 8
KMEANS_RESTARTS = 20
KMEANS_ITERATIONS = 300
SEED = 42
DBSCAN_EPS = [0.7, 0.9, 1.1, 1.3, 1.5, 1.8, 2.1]
DBSCAN_MIN_SAMPLES = [4, 6, 8, 10]
MIN_COVERAGE = 0.6
EXPLAINED_VARIANCE = 0.95
BIRCH_THRESHOLD = 0.5
BIRCH_BRANCHING = 50

# ---- fixed values: genres, axis-space neighbours, page size ----
GENRE_TOP, GENRE_MIN_SCORE = 5, 0.15
AXIS_RADIUS, AXIS_MIN_PROXIMITY, AXIS_NEIGHBOURS = 0.75, 0.24, 20
PAGE_SIZE = 50
