-- Late share of delivered orders per customer state.
SELECT c.state, count(*) AS total_orders,
       avg(if(o.delivered_ts > o.estimated_ts, 1D, 0D)) AS late_delivery_rate
FROM star_orders AS o JOIN star_customers AS c USING (customer_id)
WHERE o.delivered_ts IS NOT NULL
GROUP BY c.state
HAVING count(*) >= :state_min
ORDER BY late_delivery_rate DESC, c.state
