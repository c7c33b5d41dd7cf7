"""Small inline fixtures, made by formulas; goldens are worked out from the rows."""

# (day, uptime %, response seconds, error rate, transactions)
BILLING = [(f"2023-05-{i + 1:02d}", round(99.7 - (i * 7 % 13) * 0.25 - (4 if i % 10 == 9 else 0), 2), round(1.2 + (i * 5 % 17) * 0.45, 2),
            round((i * 3 % 8) * 0.05, 2), 30_000 + 1_250 * (i * 11 % 9)) for i in range(31)]

# (id, error rate %, initial response min, resolution min): around each limit
API_INCIDENTS = [(f"case-{i}", e, r, m) for i, (e, r, m) in enumerate(
    [(1.0, 0, 0), (0.99, 6, 121), (0.0, 5, 121), (0.5, 6, 120), (0.5, 5, 120), (50.0, 90, 600), (0.99, 5, 119)])]

# Replication-lag breaches of a database service (lag ms, limit ms, detected at)
DB_REPLICATION = [("lag-a", 101, 100, "2023-05-02 08:00:00"), ("lag-b", 400, 100, "2023-05-02 08:00:01"),
                  ("lag-c", 90, 100, "2023-05-10 12:00:00"), ("lag-d", 900, 100, "2023-05-30 23:59:59"),
                  ("lag-e", 150, 100, "2023-06-01 00:00:00")]


def billing_df(spark, tmp_path):
    p = tmp_path / "billing_rows.csv"
    p.write_text("incident_date,uptime_percent,avg_response_time,error_rate,transaction_count\n"
                 + "".join(",".join(map(str, r)) + "\n" for r in BILLING))
    from covenant.sources.files import read_data
    return read_data(spark, str(p))
