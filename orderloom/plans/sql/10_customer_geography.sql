-- Delivery timing of all delivered orders and mean order score per state.
WITH order_scores AS (
  SELECT order_id, avg(review_score) AS score FROM star_reviews GROUP BY order_id
)
SELECT c.state, count(*) AS delivered_orders,
       round(avg(datediff(o.delivered_ts, o.estimated_ts)), 2) AS avg_delay_days,
       count(s.order_id) AS orders_with_text_review, round(avg(s.score), 3) AS avg_review_score
FROM star_orders AS o JOIN star_customers AS c USING (customer_id)
LEFT JOIN order_scores AS s ON s.order_id = o.order_id
WHERE o.delivered_ts IS NOT NULL AND o.estimated_ts IS NOT NULL
GROUP BY c.state
ORDER BY delivered_orders DESC, c.state
