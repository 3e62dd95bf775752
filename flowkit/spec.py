"""Dataset specifications: which columns a flow table has and what each one is."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DatasetSpec:
    """Column roles and label groups of one dataset."""

    name: str
    features: tuple[str, ...]
    cat: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    label: str = "Label"
    drop: tuple[str, ...] = ()
    raw_columns: tuple[str, ...] = ()
    onehot: tuple[str, ...] = ()
    scaled_cat: tuple[str, ...] = ()
    port: str | None = None
    majority: tuple[str, ...] = ()
    minority: tuple[str, ...] = ()
    accept_rates: dict[str, float] = field(default_factory=dict)
    label_map: dict[str, tuple[str, ...]] = field(default_factory=dict)
    default_label: str = "Benign"
    require_all_features: bool = False
    has_quantile: bool = True

    @property
    def cont(self) -> tuple[str, ...]:
        skip = set(self.cat) | set(self.binary)
        return tuple(f for f in self.features if f not in skip)

    @property
    def numeric(self) -> tuple[str, ...]:
        """Columns the numeric scalers act on."""
        return self.scaled_cat + self.cont

    @property
    def ordered_features(self) -> tuple[str, ...]:
        """Model input order."""
        return self.cat + self.binary + self.cont

    @property
    def class_names(self) -> tuple[str, ...]:
        return tuple(sorted(self.majority + self.minority))

    def accept_rate(self, label: str) -> float:
        return self.accept_rates.get(label, DEFAULT_ACCEPT_RATE)


# --- Fixed values: column names, label names and rates of the two published datasets ---------

DEFAULT_ACCEPT_RATE = 0.30

CIC2018 = DatasetSpec(
    name="cic2018",
    features=(
        "Dst Port", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts",
        "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Fwd Pkt Len Max", "Fwd Pkt Len Min",
        "Fwd Pkt Len Mean", "Fwd Pkt Len Std", "Bwd Pkt Len Max", "Bwd Pkt Len Min",
        "Bwd Pkt Len Mean", "Bwd Pkt Len Std", "Flow Byts/s", "Flow Pkts/s",
        "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
        "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
        "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
        "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s",
        "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var",
        "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "ECE Flag Cnt",
        "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg",
        "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts",
        "Init Fwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min",
        "Active Mean", "Active Std", "Active Max", "Active Min",
        "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
    ),
    cat=("Dst Port",),
    binary=("RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "ECE Flag Cnt"),
    drop=(
        "Timestamp", "Bwd PSH Flags", "Bwd URG Flags",
        "Fwd Byts/b Avg", "Fwd Pkts/b Avg", "Fwd Blk Rate Avg",
        "Bwd Byts/b Avg", "Bwd Pkts/b Avg", "Bwd Blk Rate Avg",
        "Fwd PSH Flags", "Fwd URG Flags", "FIN Flag Cnt",
        "SYN Flag Cnt", "URG Flag Cnt", "CWE Flag Count",
        "Init Bwd Win Byts", "Protocol",
    ),
    scaled_cat=("Dst Port",),
    port="Dst Port",
    majority=(
        "Benign", "DDoS attacks-LOIC-HTTP", "DDOS attack-HOIC", "DoS attacks-Hulk", "Bot",
        "Infilteration", "SSH-Bruteforce", "DoS attacks-GoldenEye",
    ),
    minority=(
        "DoS attacks-Slowloris", "Brute Force -Web", "Brute Force -XSS", "SQL Injection",
    ),
    accept_rates={
        "DoS attacks-Slowloris": 0.30,
        "Brute Force -Web": 0.35,
        "Brute Force -XSS": 0.50,
        "SQL Injection": 0.3,
    },
)

NSLKDD = DatasetSpec(
    name="nslkdd",
    features=(
        "protocol_type", "service", "flag",
        "land", "logged_in", "is_host_login", "is_guest_login",
        "duration", "src_bytes", "dst_bytes", "wrong_fragment", "urgent", "hot",
        "num_failed_logins", "num_compromised", "root_shell", "su_attempted",
        "num_root", "num_file_creations", "num_shells", "num_access_files",
        "num_outbound_cmds", "count", "srv_count", "serror_rate", "srv_serror_rate",
        "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
        "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
        "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
        "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
        "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
        "dst_host_srv_rerror_rate",
    ),
    cat=("protocol_type", "service", "flag"),
    binary=("land", "logged_in", "is_host_login", "is_guest_login"),
    raw_columns=(
        "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
        "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
        "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
        "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
        "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
        "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
        "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
        "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
        "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
        "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "attack", "level",
    ),
    onehot=("protocol_type", "service", "flag"),
    majority=("Benign", "DoS"),
    minority=("Probe", "R2L", "U2R"),
    # The spelling of these names (also "loadmdoule" and "http_tunnel") is part of the contract:
    # a name that is not listed falls through to the default label.
    label_map={
        "DoS": (
            "apache2", "back", "land", "neptune", "mailbomb", "pod",
            "processtable", "smurf", "teardrop", "udpstorm", "worm",
        ),
        "Probe": ("ipsweep", "mscan", "nmap", "portsweep", "saint", "satan"),
        "U2R": (
            "buffer_overflow", "loadmdoule", "perl", "ps", "rootkit", "sqlattack", "xterm",
        ),
        "R2L": (
            "ftp_write", "guess_passwd", "http_tunnel", "imap", "multihop", "named", "phf",
            "sendmail", "snmpgetattack", "snmpguess", "spy", "warezclient", "warezmaster",
            "xclock", "xsnoop",
        ),
    },
    require_all_features=True,
    has_quantile=False,
)

# Voting weight of each model kind in the ensemble.
ENSEMBLE_WEIGHTS = {
    "xgb": 0.3,
    "dnn": 0.1,
    "catb": 0.2,
    "bagging": 0.2,
    "histgbm": 0.2,
    "gbm": 0.2,
}

# --- End of fixed values --------------------------------------------------------------------

SPECS = {s.name: s for s in (CIC2018, NSLKDD)}
