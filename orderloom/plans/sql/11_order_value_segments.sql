-- Reviews by value segment of their order (items and freight); both middle limits are inside.
WITH order_values AS (
  SELECT order_id,
         CASE WHEN sum(price + freight_value) < :low THEN 'Low Value'
              WHEN sum(price + freight_value) <= :high THEN 'Medium Value' ELSE 'High Value' END AS value_segment
  FROM star_items GROUP BY order_id
)
SELECT v.value_segment, count(*) AS total_reviews, avg(r.review_score) AS avg_review_score,
       avg(if(r.sentiment_label = 'Negative', 1D, 0D)) AS negative_sentiment_rate
FROM order_values AS v JOIN star_reviews AS r USING (order_id)
GROUP BY v.value_segment
ORDER BY total_reviews DESC
