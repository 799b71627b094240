-- Revenue, freight and orders per category; items of unnamed categories keep a NULL group.
SELECT p.category, count(DISTINCT i.order_id) AS total_orders,
       CAST(sum(i.price) AS DOUBLE) AS total_revenue, CAST(sum(i.freight_value) AS DOUBLE) AS total_freight
FROM star_items AS i LEFT JOIN star_products AS p USING (product_id)
GROUP BY p.category
ORDER BY total_revenue DESC
