"""Business diagnosis as Spark jobs: metrics, anomalies, contributions, merchants."""
