def sentence(rng, n):
    return " ".join(rng.choice(["able", "of", "the", "station", "éclair", "Straße", "never", "x1"]) + rng.choice(["", "", ",", "."]) for _ in range(n))
