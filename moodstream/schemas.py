"""Table schemas and the fixed values of the data model."""

from pyspark.sql import types as T

# The six audio features that describe a play, in model order.
FEATURES = [
    "valence",
    "energy",
    "danceability",
    "acousticness",
    "instrumentalness",
    "tempo_norm",
]

# The raw feature columns of a feature payload item.
PAYLOAD_FEATURES = [
    "valence",
    "energy",
    "danceability",
    "acousticness",
    "instrumentalness",
    "tempo",
]

# One play is identified by these columns.
PLAY_KEY = ["listener_id", "track_id", "played_at"]

PLAYS = T.StructType(
    [
        T.StructField("listener_id", T.LongType(), False),
        T.StructField("track_id", T.StringType(), False),
        T.StructField("played_at", T.TimestampType(), False),
        T.StructField("track_name", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("valence", T.DoubleType()),
        T.StructField("energy", T.DoubleType()),
        T.StructField("danceability", T.DoubleType()),
        T.StructField("acousticness", T.DoubleType()),
        T.StructField("instrumentalness", T.DoubleType()),
        T.StructField("tempo", T.DoubleType()),
        T.StructField("tempo_norm", T.DoubleType()),
    ]
)

HISTORY = T.StructType(
    PLAYS.fields
    + [
        T.StructField("session_id", T.LongType()),
        T.StructField("mood_cluster_id", T.IntegerType()),
    ]
)

# What new plays need to know of a listener's history.
TAILS = T.StructType(
    [
        T.StructField("listener_id", T.LongType()),
        T.StructField("latest_played_at", T.TimestampType()),
        T.StructField("last_session_id", T.LongType()),
        T.StructField("last_session_start", T.TimestampType()),
    ]
)

# One row per listener, session and date.
SESSION_DAYS = T.StructType(
    [
        T.StructField("listener_id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("first_play", T.TimestampType()),
        T.StructField("last_play", T.TimestampType()),
        T.StructField("n_plays", T.LongType()),
    ]
)

CENTROID = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])

# One row per track: its features and its names, each with the stamp of the play they come from.
CATALOGUE = T.StructType(
    [
        T.StructField("track_id", T.StringType()),
        T.StructField("sound", T.StructType([T.StructField("played_at", T.TimestampType()), *CENTROID.fields])),
        T.StructField(
            "names",
            T.StructType(
                [T.StructField("played_at", T.TimestampType())]
                + [T.StructField(n, T.StringType()) for n in ("track_name", "artist_name", "image_url")]
            ),
        ),
    ]
)

# The newest distinct tracks of a listener and mood.
SEEDS = T.StructType(
    [
        T.StructField("listener_id", T.LongType()),
        T.StructField("mood_cluster_id", T.IntegerType()),
        T.StructField("track_id", T.StringType()),
        T.StructField("last_played_at", T.TimestampType()),
        T.StructField("place", T.IntegerType()),
    ]
)

CLUSTER_MODEL = T.StructType(
    [
        T.StructField("optimal_k", T.IntegerType()),
        T.StructField(
            "clusters",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("cluster_id", T.IntegerType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("centroid", CENTROID),
                    ]
                )
            ),
        ),
    ]
)

# A cluster model never holds more moods than this.
MAX_MOODS = 15

_ARTISTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))

PLAY_PAYLOAD = T.StructType(
    [
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("played_at", T.StringType()),
                        T.StructField(
                            "track",
                            T.StructType(
                                [
                                    T.StructField("id", T.StringType()),
                                    T.StructField("name", T.StringType()),
                                    T.StructField("artists", _ARTISTS),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

TRACK_PAYLOAD = T.StructType(
    [
        T.StructField(
            "tracks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("artists", _ARTISTS),
                        T.StructField(
                            "album",
                            T.StructType(
                                [
                                    T.StructField(
                                        "images",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField("url", T.StringType()),
                                                    T.StructField("width", T.IntegerType()),
                                                ]
                                            )
                                        ),
                                    )
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

# Payload fields that may carry the track id when the link does not, in order of preference.
TRACK_ID_FIELDS = ["spotifyId", "spotify_id", "trackId", "track_id"]

FEATURE_ITEMS = T.ArrayType(
    T.StructType(
        [T.StructField("href", T.StringType())]
        + [T.StructField(name, T.StringType()) for name in TRACK_ID_FIELDS]
        + [T.StructField(name, T.DoubleType()) for name in PAYLOAD_FEATURES]
    )
)

# Envelope fields of a feature payload, in order of preference; otherwise the payload is a bare list.
FEATURE_ENVELOPES = ["content", "audioFeatures", "data"]

FEATURE_PAYLOAD = T.StructType([T.StructField(name, FEATURE_ITEMS) for name in FEATURE_ENVELOPES])
